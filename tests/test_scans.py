"""Blocked scans against plain loops, with blocks far smaller than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins as J
from strandline.operators import scans
from strandline.operators import windows as W

c = F.col


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 7)
    monkeypatch.setattr(scans, "MAPS", 4)


@pytest.fixture
def rows():
    rng = random.Random(3)
    return [(k, i, rng.uniform(-1, 1), rng.random() < 0.1, None if rng.random() < 0.5 else rng.random()) for k in ("a", "b", None) for i in range({"a": 300, "b": 1}.get(k, 70)) if rng.random() < 0.8]


KIND = "k string, i long, v double, done boolean, w double"


def test_running_sums_and_maxima(spark, small, rows):
    df = scans.running(spark.createDataFrame(rows, KIND).repartition(3), ["k"], "i", c("w"), "s")
    df = scans.running(df, ["k"], "i", c("w"), "m", largest=True)
    state = {}
    want = {}
    for k, i, _, _, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s, m = state.get(k, (None, None))
        if w is not None:
            s, m = (s or 0) + w, w if m is None else max(m, w)
        state[k] = s, m
        want[k, i] = s, m
    for r in df.collect():
        s, m = want[r.k, r.i]
        assert r.m == m and (r.s or 0) == pytest.approx(s or 0)


def test_last_and_next_values(spark, small, rows):
    df = spark.createDataFrame(rows, KIND)
    block = F.floor(c("i") / 5)
    df = scans.last_seen(df, ["k"], block, ["i"], c("w"), "before", own=False)
    df = scans.last_seen(df, ["k"], block, ["i"], c("w"), "here")
    df = scans.last_seen(df, ["k"], block, ["i"], c("w"), "after", ahead=True, own=False)
    by = {(k, i): w for k, i, _, _, w in rows}
    for r in df.collect():
        mine = sorted((i, w) for (k, i), w in by.items() if k == r.k and w is not None)
        assert r.before == next((w for i, w in reversed(mine) if i < r.i), None)
        assert r.here == next((w for i, w in reversed(mine) if i <= r.i), None)
        assert r.after == next((w for i, w in mine if i > r.i), None)


@pytest.mark.parametrize("lam", [0.0, 0.8, 1.0])
def test_advantages_are_a_scan(spark, small, rows, lam):
    dense = [(k, n, v, d) for k in ("a", "b", None) for n, (_, _, v, d, _) in enumerate(r for r in rows if r[0] == k)]
    df = spark.createDataFrame(dense, "k string, i long, v double, done boolean")
    out = W.discounted(df, "k", "i", c("v"), c("done"), c("v") / 2, 0.9, lam)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    want = {}
    for k in ("a", "b", None):
        adv = after = 0.0
        for key, i, v, d in sorted((r for r in dense if r[0] == k), key=lambda r: -r[1]):
            adv = v + 0.9 * after * (1 - d) - v / 2 + 0.9 * lam * (1 - d) * adv
            after = v / 2
            want[key, i] = adv
    got = {(r.k, r.i): r.advantage for r in out.collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_one_long_episode_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("only").alias("k"), c("id").alias("i"), (c("id") % 7 / 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = W.discounted(df, "k", "i", c("v"), F.lit(False), c("v"), 0.99, 0.95).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 100_000


def test_walks_cover_first_and_last(spark, small):
    sizes = {"none": 0, "one": 1, "two": 2, "three": 3, "long": 500}
    df = spark.createDataFrame(list(sizes.items()), "k string, n long")
    got = {}
    for r in scans.walk(df.repartition(4), "k", "n", "s").collect():
        got.setdefault(r.k, []).append(r.place)
    assert "none" not in got and sorted(got["one"]) == [0] and sorted(got["two"]) == [0, 1] and sorted(got["three"]) == [0, 2]
    places = sorted(got["long"])
    steps = [b - a for a, b in zip(places, places[1:])]
    assert places[0] == 0 and places[-1] == 499 and all(2 <= s <= 4 for s in steps[:-1]) and 1 <= steps[-1] <= 4 and set(steps) == {2, 3, 4} | {steps[-1]}
    again = {(r.k, r.place) for r in scans.walk(df.coalesce(1), "k", "n", "s").collect()}
    assert again == {(k, p) for k, v in got.items() for p in v}


@pytest.mark.parametrize("join", ["asof", "before", "nearest", "interpolated"])
def test_joins_by_time_cut_into_spans(spark, join):
    """A hot key that is cut into spans of time gives what the whole key gives."""
    rng = random.Random(6)
    left = spark.createDataFrame([(k, i, rng.randrange(500)) for i in range(300) for k in ("hot", None)], "k string, id long, t long")
    right = spark.createDataFrame([(k, i, rng.randrange(500), rng.random()) for i in range(120) for k in ("hot", None, "other")], "k string, o long, rt long, v double").dropDuplicates(["k", "rt"])
    f = {
        "asof": lambda w: J.asof(left, right, ["k"], "t", "rt", "o", ["v"], width=w),
        "before": lambda w: J.asof(left, right, ["k"], "t", "rt", "o", ["v"], allow_equal=False, width=w),
        "nearest": lambda w: J.nearest(left, right, ["k"], "t", "rt", "o", "v", width=w),
        "interpolated": lambda w: J.interpolated(left, right, ["k"], "t", "rt", "v", width=w),
    }[join]
    whole, spans = ({(r.k, r.id): r.v for r in f(w).collect()} for w in (None, 7))
    assert whole == spans and len(whole) == 600 and any(v is not None for v in whole.values())
