"""The episode generator through SQL and the mergeable quantile state."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import generators, sketches


@pytest.fixture
def table(spark):
    generators.register(spark)
    rows = [(k, i, f"w{i} x", i * 1.5) for k, n in (("a", 7), ("b", 1), (None, 3)) for i in range(n)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "k string, at long, text string, v double").repartition(3).createOrReplaceTempView("steps")
    return {k: sorted(r[1:] for r in rows if r[0] == k) for k in ("a", "b", None)}


@pytest.mark.parametrize("past,future", [(0, 0), (2, 0), (0, 3), (2, 3)])
def test_samples_of_episodes(spark, table, past, future):
    df = spark.sql(f"SELECT * FROM iter_episode(TABLE(steps), 'k', 'at', 'v', {past}, {future}, 'none')")
    assert df.schema.simpleString() == "struct<k:string,step:bigint,now:double,past:array<double>,future:array<double>>"
    want = {}
    for k, rows in table.items():
        v = [r[2] for r in rows]
        for i in range(len(v)):
            want[k, i] = (v[i], [v[max(0, i - past + j)] if i - past + j >= 0 else v[0] for j in range(past)], [v[min(len(v) - 1, i + 1 + j)] for j in range(future)])
    assert {(r.k, r.step): (r.now, r.past, r.future) for r in df.collect()} == want


def test_types_follow_the_decoder(spark, table):
    df = spark.sql("SELECT k, step, now, future FROM iter_episode(TABLE(steps), 'k', 'at', 'text', 0, 1, 'words')")
    assert dict(df.dtypes)["now"] == "array<string>" and dict(df.dtypes)["future"] == "array<array<string>>"
    assert {(r.k, r.step): r.now for r in df.collect()}["a", 3] == ["w3", "x"]
    for bad in ("'k', 'at', 'other', 0, 1, 'none'", "'k', 'at', 'v', -1, 1, 'none'", "'k', 'at', 'v', 0, 1, 'gone'"):
        with pytest.raises(Exception, match="iter_episode"):
            spark.sql(f"SELECT * FROM iter_episode(TABLE(steps), {bad})")
    assert spark.sql("SELECT * FROM iter_episode(TABLE(SELECT * FROM steps WHERE at < 0), 'k', 'at', 'v', 1, 1, 'none')").collect() == []


def test_sketches_merge_in_any_order_within_the_bound(spark, tmp_path):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) ** 3 for _ in range(30_000)]
    rows = [(i % 40, v if i % 1000 else None) for i, v in enumerate(values)] + [(99, float("nan"))]
    df = spark.createDataFrame(rows, "episode long, v double").repartition(5)
    sketches.sketched(df, ["episode"], {"v": F.col("v")}).write.parquet(str(tmp_path / "s"))
    states = spark.read.parquet(str(tmp_path / "s"))
    kept = sorted(v for _, v in rows if v is not None and v == v)
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    pairs = sketches.merged(states.withColumn("g", F.col("episode") % 2), ["g"], ["v"])
    for whole in (sketches.merged(states, [], ["v"]), sketches.merged(pairs.orderBy(F.desc("g")), [], ["v"])):
        r = sketches.rank(sketches.quantiles(whole, "v", shares), "v", F.lit(0.0)).first()
        assert r.n == len(rows)
        for share, answer in zip(shares, r.quantiles):
            assert abs(sum(v <= answer for v in kept) / len(kept) - share) < 3 * sketches.rank_error()
        assert abs(r["rank"] - sum(v <= 0 for v in kept) / len(kept)) < 3 * sketches.rank_error()
    assert sketches.quantiles(states.filter("episode = 99"), "v", [0.5]).first().quantiles is None
