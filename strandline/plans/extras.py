"""Smaller operators: stamps, multi-key deltas, masks, cached statistics, rotation interpolation, shard ports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import joins as J
from strandline.operators import ranks
from strandline.operators import stats as S
from strandline.plans.common import FRAMES, frames
from strandline.sources.tables import table

c = F.col
PRIORITIES = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"


def stamps(spark, root):
    """ISO-8601 UTC stamps and durations in milliseconds to three places."""
    w = Window.partitionBy("episode").orderBy("frame")
    f = frames(spark, root).withColumn("micros", F.unix_micros(c("ts").cast("timestamp")))
    stamp = F.concat(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return f.select("event_id", stamp.alias("stamp"), F.round((c("micros") - F.lag("micros").over(w)) / 1000, 3).alias("duration_ms"))


def multi_key_delta(spark, root):
    """Two named parts joined, the masked state taken off, split again."""
    e = table(spark, root, "embeddings")
    parts = e.select("vec_id", V.doubles(F.slice("embedding", 1, 3)).alias("arm"), V.doubles(F.slice("embedding", 4, 2)).alias("hand"), V.doubles(F.slice("embedding", 11, 5)).alias("state"))
    d = parts.withColumn("d", V.minus_where(F.concat("arm", "hand"), c("state"), V.bool_mask(3, -1, 1)))
    rows = d.select("vec_id", F.slice("d", 1, 3).alias("arm"), F.slice("d", 4, 2).alias("hand"))
    return rows.select("vec_id", *[F.round(V.at(c("arm"), i), 6).alias(f"arm{i}") for i in range(3)], *[F.round(V.at(c("hand"), i), 6).alias(f"hand{i}") for i in range(2)])


def operational_mask(spark, root):
    e = frames(spark, root).groupBy("episode").agg(F.count("*").cast("int").alias("n"))
    return e.select("episode", F.array_join(F.transform(F.array_repeat(F.lit(True), c("n")), lambda x: x.cast("int").cast("string")), "").alias("mask"))


def cached_stats(spark, root):
    """Statistics found by their configuration: the newest entry with the same normalised settings wins.

    Entries and requests spell a configuration differently (case, blanks, order); both are brought into one form.
    """
    entries = table(spark, root, "orders").select(S.config_key({"Status": c("o_orderstatus"), "priority": c("o_orderpriority"), "clerk": c("o_orderkey") % 7}).alias("config"), "o_orderkey", "o_totalprice")
    cache = S.stats_cache(entries, "config", "o_orderkey", ["o_totalprice"])
    asked = table(spark, root, "customer").select(
        "c_custkey", S.config_key({"CLERK": c("c_custkey") % 9, "Priority": F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(k) for k in PRIORITIES]), (c("c_custkey") % 5 + 1).cast("int"))), "status": F.when(c("c_acctbal") > 0, "o ").otherwise("f")}).alias("config")
    )
    return asked.join(cache, "config", "left").select("c_custkey", c("o_totalprice").alias("cached"), c("o_orderkey").alias("made"))


def shard_ports(spark, root):
    """Successful episodes dealt to 5 shards, numbered inside each."""
    o = table(spark, root, "orders").filter("o_orderstatus = 'O'").withColumn("shard", c("o_orderkey") % 5)
    return ranks.position(o, "o_orderkey", ["shard"]).select("o_orderkey", "shard", c("rank").alias("place"))


def slerped(spark, root):
    """Rotation between two quaternions of each vector at a quarter of the way."""
    x = lambda i: V.at(V.doubles(c("embedding")), i)
    q = table(spark, root, "embeddings").select("vec_id", V.euler_to_quaternion(x(0), x(1), x(2)).alias("a"), V.euler_to_quaternion(x(3) * 5, x(4), x(5)).alias("b"))
    s = q.select("vec_id", V.slerp(c("a"), c("b"), F.lit(0.25)).alias("s"))
    return s.select("vec_id", *[F.round(V.at(c("s"), i), 6).alias(f"q{i}") for i in range(4)])


def global_lookup(spark, root):
    """Data set and local number of global frame numbers: cumulative lengths of the nations' customers."""
    n = table(spark, root, "customer").groupBy("c_nationkey").agg(F.count("*").alias("length"))
    spans = J.offsets(n.withColumn("c_nationkey", c("c_nationkey").cast("long")), "c_nationkey", "length")
    asked = table(spark, root, "orders").select("o_orderkey", (c("o_orderkey") * 7 % table(spark, root, "customer").count()).alias("i"))
    return J.range_join(asked, "i", spans, "start", "stop", 16).select("o_orderkey", "c_nationkey", (c("i") - c("start")).alias("local"))


def quat(prefix, r, p, y):
    return f"""cos({r}/2)*cos({p}/2)*cos({y}/2) + sin({r}/2)*sin({p}/2)*sin({y}/2) AS {prefix}0, sin({r}/2)*cos({p}/2)*cos({y}/2) - cos({r}/2)*sin({p}/2)*sin({y}/2) AS {prefix}1,
               cos({r}/2)*sin({p}/2)*cos({y}/2) + sin({r}/2)*cos({p}/2)*sin({y}/2) AS {prefix}2, cos({r}/2)*cos({p}/2)*sin({y}/2) - sin({r}/2)*sin({p}/2)*cos({y}/2) AS {prefix}3"""


QUERIES = [
    ("t15_stamps", stamps, f"WITH {FRAMES} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY episode ORDER BY frame)) / 1000, 3) AS duration_ms FROM f"),
    ("v18_multi_key_delta", multi_key_delta, "SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE) - CAST(embedding[{i + 11}] AS DOUBLE), 6) AS arm{i}" for i in range(3)) + ", round(CAST(embedding[4] AS DOUBLE), 6) AS hand0, round(CAST(embedding[5] AS DOUBLE) - CAST(embedding[15] AS DOUBLE), 6) AS hand1 FROM embeddings"),
    ("v21_operational_mask", operational_mask, "SELECT user_id AS episode, repeat('1', count(*)) AS mask FROM events GROUP BY 1"),
    ("v22_cached_stats", cached_stats, "WITH k AS (SELECT o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 7 AS c, arg_max(o_totalprice, o_orderkey) AS cached, max(o_orderkey) AS made FROM orders GROUP BY 1, 2, 3) SELECT c_custkey, cached, made FROM customer LEFT JOIN k ON k.c = c_custkey % 9 AND k.p = " + str(list(PRIORITIES)) + "[c_custkey % 5 + 1] AND k.s = CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END"),
    ("v25_b06_shard_ports", shard_ports, "SELECT o_orderkey, o_orderkey % 5 AS shard, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'O'"),
    ("w18_slerp", slerped, f"""
        WITH e AS (SELECT vec_id, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(6))} FROM embeddings),
        q AS (SELECT vec_id, {quat("a", "x0", "x1", "x2")}, {quat("b", "(x3 * 5)", "x4", "x5")} FROM e),
        d AS (SELECT *, a0*b0 + a1*b1 + a2*b2 + a3*b3 AS raw FROM q),
        g AS (SELECT *, acos(least(abs(raw), 1.0)) AS angle, CASE WHEN raw < 0 THEN -1 ELSE 1 END AS sign FROM d),
        k AS (SELECT *, CASE WHEN abs(raw) > 0.9995 THEN 0.75 ELSE sin(0.75 * angle) / sin(angle) END AS wa, CASE WHEN abs(raw) > 0.9995 THEN 0.25 ELSE sin(0.25 * angle) / sin(angle) END * sign AS wb FROM g),
        m AS (SELECT vec_id, a0*wa + b0*wb AS m0, a1*wa + b1*wb AS m1, a2*wa + b2*wb AS m2, a3*wa + b3*wb AS m3 FROM k)
        SELECT vec_id, {", ".join(f"round(m{i} / sqrt(m0*m0 + m1*m1 + m2*m2 + m3*m3), 6) AS q{i}" for i in range(4))} FROM m"""),
    ("j05_global_lookup", global_lookup, "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT c_nationkey, CAST(sum(n) OVER (ORDER BY c_nationkey) AS BIGINT) - n AS lo, CAST(sum(n) OVER (ORDER BY c_nationkey) AS BIGINT) AS hi FROM n), o AS (SELECT o_orderkey, o_orderkey * 7 % (SELECT count(*) FROM customer) AS i FROM orders) SELECT o_orderkey, c_nationkey::BIGINT AS c_nationkey, i - lo AS local FROM o JOIN s ON i >= lo AND i < hi"),
]
