"""Vector statistics and normalisation over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import stats as S
from strandline.plans.common import VECTORS
from strandline.sources.tables import table


def _with_stats(spark, root):
    rows = table(spark, root, "embeddings").withColumn("x", V.doubles(F.col("embedding")))
    stats = S.as_vectors(S.vector_stats(rows, "embedding"), "mean", "std", "min", "max", "q01", "q99")
    return rows.crossJoin(F.broadcast(stats))  # one row of 64-wide arrays


def _out(df, column, places=6):
    return df.select("vec_id", F.posexplode(column).alias("dim", "y")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("y", places).alias("y"))


def _scaled(make):
    return lambda spark, root: _out(_with_stats(spark, root), make())


def _sql(expr, more=""):
    return f"WITH {VECTORS} SELECT vec_id, dim, round({expr}, 6) AS y FROM e JOIN s USING (dim) {more}"


c = F.col
CLIP = "greatest(least({0}, 1.0), -1.0)"


def mask():
    return V.bool_mask(48, -16)


def stats_query(spark, root):
    s = S.vector_stats(table(spark, root, "embeddings"), "embedding")
    return s.select(F.col("dim").cast("long").alias("dim"), "n", *[F.round(n, 6).alias(n) for n in ("mean", "std", "min", "max", "q01", "q99")])


def norms(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", V.doubles(c("embedding")).alias("x"))
    return rows.select("vec_id", F.round(V.norm(c("x")), 6).alias("norm"), V.has_outlier(c("x"), 0.3).alias("outlier"))


def outlier_dims(spark, root):
    rows = S.long_form(table(spark, root, "embeddings"), "embedding", "vec_id").filter(F.abs("x") > 0.3)
    return rows.groupBy("vec_id").agg(F.count("*").alias("n_dims"), F.min("dim").cast("long").alias("first_dim"), F.max(F.round(F.abs("x"), 6)).alias("worst"))


def padded(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", V.doubles(F.slice("embedding", 1, 5)).alias("x"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip(V.padded(c("x"), 8).alias("a"), V.pad_mask(c("x"), 8).alias("m"), V.fixed(c("x"), 8).alias("b"))).alias("dim", "z")).select(
        "vec_id", c("dim").cast("long").alias("dim"), F.round("z.a", 6).alias("padded"), c("z.m").alias("real"), F.round("z.b", 6).alias("fixed")
    )


def remapped(spark, root):
    """Scatter of 4 leading dims to fixed places of 12, zeros elsewhere."""
    x = V.doubles(c("embedding"))
    spread = F.concat(F.array_repeat(F.lit(0.0), 2), F.slice(x, 1, 2), F.array_repeat(F.lit(0.0), 4), F.slice(x, 3, 2), F.array_repeat(F.lit(0.0), 2))
    return _out(table(spark, root, "embeddings").select("vec_id", spread.alias("v")), c("v"))


def parts(spark, root):
    """Split into named parts and back in another order."""
    rows = table(spark, root, "embeddings").select("vec_id", F.struct(F.slice("embedding", 1, 32).alias("arm"), F.slice("embedding", 33, 32).alias("hand")).alias("p"))
    return _out(rows.select("vec_id", F.concat("p.hand", "p.arm").cast("array<double>").alias("v")), c("v"))


def subsampled(spark, root):
    x = V.doubles(c("embedding"))
    return _out(table(spark, root, "embeddings").select("vec_id", V.every(x, 8).alias("v")), c("v"))


def chunked(spark, root):
    x = V.doubles(c("embedding"))
    rows = table(spark, root, "embeddings").select("vec_id", F.posexplode(V.chunks(x, 10)).alias("piece", "v"))
    return rows.select("vec_id", c("piece").cast("long").alias("piece"), F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def resampled(spark, root):
    x = V.doubles(c("embedding"))
    return _out(table(spark, root, "embeddings").select("vec_id", V.resampled(x, 20).alias("v")), c("v"))


def tokens(spark, root):
    x = V.doubles(c("embedding"))
    rows = table(spark, root, "embeddings").select("vec_id", V.action_tokens(x).alias("t")).withColumn("back", V.action_values(c("t")))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("t", "back")).alias("dim", "z")).select("vec_id", c("dim").cast("long").alias("dim"), c("z.t").alias("token"), F.round("z.back", 6).alias("value"))


def round_trip(kind):
    def f(spark, root):
        d = _with_stats(spark, root)
        pairs = {
            "z": lambda x: V.unzscore(V.zscore(x, c("mean"), c("std")), c("mean"), c("std")),
            "q": lambda x: V.unquantile_norm(V.quantile_norm(x, c("q01"), c("q99")), c("q01"), c("q99")),
            "m": lambda x: V.unminmax(V.minmax(x, c("min"), c("max")), c("min"), c("max")),
            "t": lambda x: V.unlinear_tails(V.linear_tails(x, c("q01"), c("q99")), c("q01"), c("q99")),
            "a": lambda x: V.unsquash(V.squash(x, c("max")), c("max")),
        }
        return _out(d.withColumn("y", pairs[kind](c("x"))), c("y"))

    return f


PLAIN = f"WITH {VECTORS} SELECT vec_id, dim, round(x, 6) AS y FROM e"


def deltas(spark, root):
    """Masked difference to the vector before (by id); the first is compared with itself."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, root, "embeddings").withColumn("x", V.doubles(c("embedding")))
    rows = rows.withColumn("p", F.coalesce(F.lag("x").over(w), c("x")))
    return _out(rows.select("vec_id", V.minus_where(c("x"), c("p"), mask()).alias("v")), c("v"))


def delta_back(spark, root):
    rows = table(spark, root, "embeddings").withColumn("x", V.doubles(c("embedding")))
    half = F.transform("x", lambda v: v / 2)
    return _out(rows.select("vec_id", V.plus_where(V.minus_where(c("x"), half, mask()), half, mask()).alias("v")), c("v"))


def angles(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", F.transform(V.doubles(c("embedding")), lambda v: v * 3).alias("x"))
    z = F.arrays_zip(F.transform("x", V.wrap_angle).alias("a"), F.transform("x", lambda v: V.wrap_once(v, V.PI)).alias("b"))
    return rows.select("vec_id", F.posexplode(z).alias("dim", "z")).select("vec_id", c("dim").cast("long").alias("dim"), F.round("z.a", 6).alias("wrapped"), F.round("z.b", 6).alias("once"))


def rotations(spark, root):
    """Euler angles to quaternion, matrix, six numbers and back to a matrix, axis-angle, and the rotation of a base frame
    seen from a wrist frame (the product of the transposed wrist rotation and the base's)."""
    x = lambda i: V.at(V.doubles(c("embedding")), i)
    rows = table(spark, root, "embeddings").select("vec_id", V.euler_to_quaternion(x(0), x(1), x(2)).alias("q"))
    rows = rows.withColumn("m", V.quaternion_to_matrix(c("q"))).join(table(spark, root, "embeddings").select("vec_id", V.quaternion_to_matrix(V.euler_to_quaternion(x(3), x(4), x(5))).alias("wrist")), "vec_id")
    rows = rows.withColumn("back", V.six_to_matrix(V.matrix_to_six(c("m")))).withColumn("seen", V.matmul3(V.transpose3(c("wrist")), c("m"))).withColumn("aa", V.axis_angle(c("q")))
    return rows.select(
        "vec_id",
        *[F.round(V.at(c("q"), i), 6).alias(f"q{i}") for i in range(4)],
        *[F.round(V.at(c(name), i), 6).alias(f"{name}{i}") for name in ("m", "back", "seen") for i in range(9)],
        *[F.round(V.at(c("aa"), i), 6).alias(f"axis{i}") for i in range(3)],
    )


def euler_sql(name, i):
    """CTEs of a rotation matrix ``name``0..8 by elementary rotations Rz Ry Rx of three numbers (not by a quaternion)."""
    r, p, y = (f"CAST(embedding[{i + k}] AS DOUBLE)" for k in (1, 2, 3))
    entries = (
        f"cos({y})*cos({p})", f"cos({y})*sin({p})*sin({r}) - sin({y})*cos({r})", f"cos({y})*sin({p})*cos({r}) + sin({y})*sin({r})",
        f"sin({y})*cos({p})", f"sin({y})*sin({p})*sin({r}) + cos({y})*cos({r})", f"sin({y})*sin({p})*cos({r}) - cos({y})*sin({r})",
        f"-sin({p})", f"cos({p})*sin({r})", f"cos({p})*cos({r})",
    )
    return ", ".join(f"{e} AS {name}{k}" for k, e in enumerate(entries))


SEEN = ", ".join("round(" + " + ".join(f"w{3 * k + r} * m{3 * k + c_}" for k in range(3)) + f", 6) AS seen{3 * r + c_}" for r in range(3) for c_ in range(3))
ROTATIONS_SQL = f"""
    WITH a AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) / 2 AS r, CAST(embedding[2] AS DOUBLE) / 2 AS p, CAST(embedding[3] AS DOUBLE) / 2 AS y, {euler_sql("m", 0)}, {euler_sql("w", 3)} FROM embeddings),
    q AS (SELECT *, cos(r)*cos(p)*cos(y) + sin(r)*sin(p)*sin(y) AS q0, sin(r)*cos(p)*cos(y) - cos(r)*sin(p)*sin(y) AS q1,
                 cos(r)*sin(p)*cos(y) + sin(r)*cos(p)*sin(y) AS q2, cos(r)*cos(p)*sin(y) - sin(r)*sin(p)*cos(y) AS q3 FROM a),
    n AS (SELECT *, sqrt(q1*q1 + q2*q2 + q3*q3) AS n FROM q)
    SELECT vec_id, {", ".join(f"round(q{i}, 6) AS q{i}" for i in range(4))}, {", ".join(f"round(m{i}, 6) AS m{i}, round(m{i}, 6) AS back{i}" for i in range(9))}, {SEEN},
           {", ".join(f"round(CASE WHEN n < 1e-12 THEN 2 * q{i + 1} ELSE q{i + 1} / n * 2 * atan2(n, q0) END, 6) AS axis{i}" for i in range(3))} FROM n"""

QUERIES = [
    ("a06_vector_stats", stats_query, f"WITH {VECTORS} SELECT dim, (SELECT count(*) FROM embeddings) AS n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM s"),
    ("m01_zscore", _scaled(lambda: V.zscore(c("x"), c("mean"), c("std"))), _sql("(x - mean) / (std + 1e-6)")),
    ("m02_quantile_norm", _scaled(lambda: V.quantile_norm(c("x"), c("q01"), c("q99"))), _sql("(x - q01) / (q99 - q01 + 1e-6) * 2 - 1")),
    ("m03_inverse_zscore", round_trip("z"), PLAIN),
    ("m03_inverse_quantile", round_trip("q"), PLAIN),
    ("m04_bounds", _scaled(lambda: V.bounded(c("x"), c("min"), c("max"), mask())), _sql("CASE WHEN dim < 48 THEN CASE WHEN lo = hi THEN 0.0 ELSE " + CLIP.format("2 * (x - lo) / (hi - lo + 1e-8) - 1") + " END ELSE x END")),
    ("m04_bounds_q99", _scaled(lambda: V.bounded(c("x"), c("q01"), c("q99"))), _sql(CLIP.format("2 * (x - q01) / (q99 - q01 + 1e-8) - 1"))),
    ("m05_minmax", _scaled(lambda: V.minmax(c("x"), c("min"), c("max"))), _sql("2 * (x - lo) / (hi - lo) - 1")),
    ("m05_inverse_minmax", round_trip("m"), PLAIN),
    ("m06_mean_std", _scaled(lambda: V.zscore(c("x"), c("mean"), c("std"), 1e-8)), _sql("(x - mean) / (std + 1e-8)")),
    ("m07_midpoint_range", _scaled(lambda: V.midpoint_range(c("x"), c("min"), c("max"), 1e-7)), _sql("(x - (lo + hi) / 2) * 2 / (hi - lo)")),
    ("m08_delta", deltas, f"WITH {VECTORS}, p AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY label, dim ORDER BY vec_id), x) AS b FROM e) SELECT vec_id, dim, round(x - CASE WHEN dim < 48 THEN b ELSE 0 END, 6) AS y FROM p"),
    ("m08_absolute", delta_back, PLAIN),
    ("m09_m11_wrap", angles, f"WITH {VECTORS} SELECT vec_id, dim, round(atan2(sin(x * 3), cos(x * 3)), 6) AS wrapped, round(CASE WHEN x * 3 > pi() THEN x * 3 - 2 * pi() WHEN x * 3 < -pi() THEN x * 3 + 2 * pi() ELSE x * 3 END, 6) AS once FROM e"),
    ("m10_m12_binarise", lambda s, r: _out(table(s, r, "embeddings").withColumn("v", V.binarise(V.doubles(c("embedding")), [0.0, 0.5] + [None] * 62)), c("v")), f"WITH {VECTORS} SELECT vec_id, dim, round(CASE WHEN dim < 2 THEN CASE WHEN x > dim * 0.5 THEN 1.0 ELSE 0.0 END ELSE x END, 6) AS y FROM e"),
    ("m13_asinh", _scaled(lambda: V.squash(c("x"), c("max"))), _sql("ln(x / (1.5 * hi) + sqrt((x / (1.5 * hi)) ** 2 + 1))")),
    ("m13_inverse_asinh", round_trip("a"), PLAIN),
    ("m14_linear_tails", _scaled(lambda: V.linear_tails(c("x"), c("q01"), c("q99"))), _sql("CASE WHEN x > q99 THEN q99 + ln(1 + x - q99) WHEN x < q01 THEN q01 - ln(1 + q01 - x) ELSE x END")),
    ("m14_inverse_tails", round_trip("t"), PLAIN),
    ("m15_sin_cos", lambda s, r: _out(table(s, r, "embeddings").withColumn("v", V.sin_cos(V.doubles(c("embedding")))), c("v")), f"WITH {VECTORS} SELECT vec_id, dim, round(sin(x), 6) AS y FROM e UNION ALL SELECT vec_id, dim + 64, round(cos(x), 6) FROM e"),
    ("m16_action_tokens", tokens, f"WITH {VECTORS}, t AS (SELECT vec_id, dim, CAST(32000 - least(floor((greatest(least(x, 1.0), -1.0) + 1) / (2.0 / 255)) + 1, 256) AS INTEGER) AS token FROM e) SELECT vec_id, dim, token, round(-1 + (greatest(least(32000 - token - 1, 254), 0) + 0.5) * (2.0 / 255), 6) AS value FROM t"),
    ("m17_invert", lambda s, r: _out(table(s, r, "embeddings").withColumn("v", F.transform(V.doubles(c("embedding")), lambda v: 1 - v)), c("v")), f"WITH {VECTORS} SELECT vec_id, dim, round(1 - x, 6) AS y FROM e"),
    ("m18_m19_rotations", rotations, ROTATIONS_SQL),
    ("m20_f17_norms", norms, f"WITH {VECTORS} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, bool_or(abs(x) > 0.3) AS outlier FROM e GROUP BY vec_id"),
    ("f17_outlier_dims", outlier_dims, f"WITH {VECTORS} SELECT vec_id, count(*) AS n_dims, min(dim) AS first_dim, max(round(abs(x), 6)) AS worst FROM e WHERE abs(x) > 0.3 GROUP BY vec_id"),
    ("p09_p10_v15_padded", padded, "WITH d AS (SELECT vec_id, embedding, unnest(range(8)) AS dim FROM embeddings) SELECT vec_id, dim, round(CASE WHEN dim < 5 THEN CAST(embedding[dim + 1] AS DOUBLE) ELSE 0 END, 6) AS padded, dim < 5 AS real, round(CASE WHEN dim < 5 THEN CAST(embedding[dim + 1] AS DOUBLE) ELSE 0 END, 6) AS fixed FROM d"),
    ("p11_parts", parts, "WITH d AS (SELECT vec_id, embedding, unnest(range(64)) AS dim FROM embeddings) SELECT vec_id, dim, round(CAST(embedding[(dim + 32) % 64 + 1] AS DOUBLE), 6) AS y FROM d"),
    ("p19_subsample", subsampled, "WITH d AS (SELECT vec_id, embedding, unnest(range(8)) AS dim FROM embeddings) SELECT vec_id, dim, round(CAST(embedding[dim * 8 + 1] AS DOUBLE), 6) AS y FROM d"),
    ("p20_chunks", chunked, f"WITH {VECTORS} SELECT vec_id, dim // 10 AS piece, count(*) AS n, round(sum(x), 6) AS total FROM e GROUP BY ALL"),
    ("v04_v20_remap", remapped, "WITH d AS (SELECT vec_id, embedding, unnest(range(12)) AS dim FROM embeddings) SELECT vec_id, dim, round(CASE WHEN dim IN (2, 3) THEN CAST(embedding[dim - 1] AS DOUBLE) WHEN dim IN (8, 9) THEN CAST(embedding[dim - 5] AS DOUBLE) ELSE 0 END, 6) AS y FROM d"),
    ("v07_clipped_quantiles", _scaled(lambda: F.transform(V.quantile_norm(c("x"), c("q01"), c("q99")), lambda v: V.clipped(v, -1.5, 1.5))), _sql("greatest(least((x - q01) / (q99 - q01 + 1e-6) * 2 - 1, 1.5), -1.5)")),
    ("v09_resample", resampled, "WITH d AS (SELECT vec_id, embedding, unnest(range(20)) AS dim FROM embeddings), t AS (SELECT *, dim * 63 / 19.0::DOUBLE AS t, CAST(floor(dim * 63 / 19.0::DOUBLE) AS INTEGER) AS a FROM d) SELECT vec_id, dim, round(CAST(embedding[a + 1] AS DOUBLE) + (CAST(embedding[least(a + 1, 63) + 1] AS DOUBLE) - CAST(embedding[a + 1] AS DOUBLE)) * (t - a), 6) AS y FROM t"),
    ("v17_unit_range", _scaled(lambda: V.unit_range(c("x"), c("min"), c("max"))), _sql("(x - lo) / (hi - lo + 1e-8)")),
]
