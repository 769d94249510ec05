"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import vectors as V
from strandline.operators import edits, joins, ranks, reshape, sampling, stats
from strandline.operators import windows as W


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_delta_action_on_masked_dims(spark):
    mask = V.bool_mask(-1, 1)
    assert one(spark, V.minus_where(arr(3, 4, 5), arr(1, 2, 3), mask)) == [3, 2, 5]
    assert one(spark, V.minus_where(arr(5, 6, 7), arr(1, 2, 3), mask)) == [5, 4, 7]
    assert one(spark, V.bool_mask(2, -2, 2)) == [True, True, False, False, True, True]


def test_stats_of_arange(spark):
    rows = spark.createDataFrame([([float(3 * i + j) for j in range(3)],) for i in range(4)], "v array<double>")
    got = {r.dim: r for r in stats.vector_stats(rows, "v").collect()}
    assert [got[d].mean for d in range(3)] == [4.5, 5.5, 6.5]
    assert all(abs(got[d].std - math.sqrt(11.25)) < 1e-12 for d in range(3))


def test_weighted_merge(spark):
    rows = spark.createDataFrame([(3.0, 0.0, 1.0, -1.0, 1.0, -1.0, 1.0), (1.0, 2.0, 1.0, 0.0, 4.0, 0.0, 4.0)], "w double, mean double, std double, min double, max double, q01 double, q99 double")
    r = stats.weighted_merge(rows, "w").first()
    assert (r["mean"], r["min"], r["max"], r.q99) == (0.5, -1.0, 4.0, 1.75) and abs(r["std"] ** 2 - 1.75) < 1e-12


def test_boundaries_of_579_frames_and_keyframes(spark):
    f = spark.range(579).select(F.lit(0).alias("e"), F.col("id").alias("frame"))
    got = sorted(r.frame for r in W.boundaries(f, "e", "frame", 25).collect())
    assert got[:4] == [0, 25, 50, 75] and got[-1] == 578
    assert one(spark, W.spread_indices(F.lit(26), 6)) == [0, 5, 10, 15, 20, 25]
    assert one(spark, W.spread_indices(F.lit(4), 6)) == [0, 1, 2, 3]


def test_padding_masks_tokens_and_wraps(spark):
    assert one(spark, V.padded(arr(1, 2), 4)) == [1, 2, 0, 0] and one(spark, V.padded(arr(1, 2, 3), 2)) == [1, 2, 3]
    assert one(spark, V.fixed(arr(1, 2, 3), 2)) == [1, 2]
    assert one(spark, V.is_prefix_mask(F.array(F.lit(True), F.lit(False), F.lit(True)))) is False
    assert one(spark, V.action_tokens(arr(-1, 1, 5))) == [31999, 31744, 31744]
    assert abs(one(spark, V.wrap_once(F.lit(4.0), V.PI)) - (4 - 2 * math.pi)) < 1e-12
    assert one(spark, V.chunks(arr(1, 2, 3), 2)) == [[1, 2], [3]]


def test_reverse_and_forward_fills(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.5, 0.99, 0.5, 0.0, 0.4])], "e int, f int, v double")
    w = W.in_order("e", "f")
    decided = F.when(F.col("v") > 0.95, 1.0).when(F.col("v") < 0.05, 0.0)
    assert [r.s for r in rows.select("f", W.from_next_decided(decided, F.col("v"), w).alias("s")).orderBy("f").collect()] == [1.0, 1.0, 0.0, 0.0, 0.4]
    signs = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, -1, 0, 1])], "e int, f int, v double")
    assert [r.s for r in signs.select("f", W.from_last_sign(F.col("v"), w).alias("s")).orderBy("f").collect()] == [1.0, -1.0, -1.0, 1.0]


def test_joins_on_edges(spark):
    points = spark.createDataFrame([(0.0,), (10.0,), (99.9,)], "t double")
    ranges = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 100.0, "b")], "lo double, hi double, n string")
    assert sorted((r.t, r.n) for r in joins.range_join(points, "t", ranges, "lo", "hi", 7.0).collect()) == [(0.0, "a"), (10.0, "b"), (99.9, "b")]
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 3.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, 1), (1, 3.0, 2), (1, 3.0, 3)], "k int, rt double, i int")
    assert [(r.t, r.i) for r in joins.asof(left, right, ["k"], "t", "rt", "i", ["i"]).orderBy("t").collect()] == [(0.5, None), (2.0, 1), (3.0, 3)]
    assert [(r.t, r.i) for r in joins.asof(left, right, ["k"], "t", "rt", "i", ["i"], False).orderBy("t").collect()] == [(0.5, None), (2.0, 1), (3.0, 1)]
    assert {r.t: r.i for r in joins.nearest(left, right, ["k"], "t", "rt", "i", "i").collect()}[2.0] == 1


def test_blocked_ranks_equal_plain_ones(spark):
    df = spark.range(0, 20_000, 3).withColumn("k", F.col("id") % 2)
    got = ranks.position(df, "id", ["k"]).collect()
    for k in (0, 1):
        ids = sorted(r.id for r in got if r.k == k)
        assert [r.rank for r in sorted((r for r in got if r.k == k), key=lambda r: r.id)] == list(range(len(ids))) and all(r.total == len(ids) for r in got if r.k == k)


def test_sampler_invariants(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("task"))
    b = sampling.group_batches(df, "id", "task", "id", 8, 5, 1, 0).collect()
    assert {r.batch for r in b} == set(range(12))
    for batch in range(12):
        docs = {r.id for r in b if r.batch == batch}
        assert len(docs) == 8
        for d in docs:
            s = [r.sample for r in b if r.batch == batch and r.id == d]
            assert len(set(s)) == 5 and all(x % 4 == d % 4 for x in s)
    again = sampling.group_batches(df.repartition(7), "id", "task", "id", 8, 5, 1, 0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, b))
    assert sorted(map(tuple, sampling.group_batches(df, "id", "task", "id", 8, 5, 1, 1).collect())) != sorted(map(tuple, b))
    parts = sampling.allocate(spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 1.0)], "n string, w double"), "n", "w", 10).collect()
    assert sum(r.part for r in parts) == 10 and min(r.part for r in parts) >= 1
    items = spark.createDataFrame([(3, 3), (1, 5), (4, 2), (2, 4)], "item int, n int").repartition(3)
    assert {r.item: r.shard for r in sampling.greedy_balance(items, "item", "item", "n", 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_trees(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a/b` int, `a/c` int, d int")
    nested = reshape.unflatten(df)
    assert nested.first().a.c == 2 and reshape.flatten(nested).columns == ["a/b", "a/c", "d"]
    with pytest.raises(ValueError, match="two leaves"):
        reshape.rename_paths(nested, {"a/.*": "x"})
    with pytest.raises(ValueError, match="leaf and a node"):
        reshape.repack(nested, {"x": "d", "x/y": "d"})
    with pytest.raises(KeyError):
        reshape.apply_at(nested, ["nope"], lambda c: c)
    assert reshape.only_features(["image_a", "arm.pos", "hand"], ["^arm"]) == ["image_a", "arm.pos"]
    ident = reshape.keeping(["d"], lambda x: x.select("_identity", F.lit(7).alias("z")))(df)
    assert tuple(ident.first()) == (3, 7)
    fwd, back = reshape.compose([lambda x: x.withColumn("o", F.lit("1"))], [lambda x: x.withColumn("o", F.concat("o", F.lit("b")))], [], [lambda x: x.withColumn("o", F.concat("o", F.lit("a")))])
    assert back(fwd(df)).first().o == "1ab"


def test_text(spark):
    assert one(spark, X.slug(F.lit(" Pick & Place! "))) == "pick-place"
    assert one(spark, X.route("{i:03d}/{j}", i=F.lit(7), j=F.lit(12345))) == "007/12345"
    assert one(spark, X.canonical_json(b=F.lit("1"), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_edits(spark):
    a, b = spark.createDataFrame([(5, "x"), (9, "y")], "e long, t string"), spark.createDataFrame([(5, "z", 1)], "e long, t string, more int")
    m = edits.reindex(edits.merge([a, b]), "e", "n", ["dataset_index"])
    assert sorted((r.dataset_index, r.e, r.n) for r in m.collect()) == [(0, 5, 0), (0, 9, 1), (1, 5, 2)]
    assert [(r.e, r.new_e) for r in edits.delete(a, "e", a.filter("e = 5").select("e")).collect()] == [(9, 0)]
    s = edits.split(spark.range(50).withColumnRenamed("id", "e"), "e", {"train": 0.8, "val": 0.2}, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 40, "val": 10}
