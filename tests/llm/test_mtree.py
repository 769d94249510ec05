import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import mtree

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, every=100):
    kept = []
    for r in rows:
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            kept.append((r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]))
    out = []
    for i, (ident, q) in enumerate(kept):
        if ident is None or ident % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), 1 if c is None else 0, c or 0, c) for j, (c, v) in enumerate(kept) if j != i]
        out += [(ident, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(n, dim, seed, copies=0.0, start=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.1 * rng.normal(size=(n, dim))
    x[rng.random(n) < copies] = x[0]
    return [(start + i, [float(v) for v in row], 0) for i, row in enumerate(x.astype(np.float32))]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PAGE", 8), ("TREE", 60), ("PACKED", 4), ("ROWS", 2)):
        monkeypatch.setattr(mtree, name, value)


@pytest.mark.parametrize("seed,copies", [(1, 0.0), (2, 0.35)])
def test_results_match_brute_force(spark, small, seed, copies):
    rows = clustered(700, 6, seed, copies)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(mtree.top_k(df, F.col("id") % 20 == 0)) == brute(rows, every=20)


def test_nulls_repeats_lengths_and_range(spark, small):
    rng = random.Random(5)
    rows = clustered(60, 3, 3) + [(100, [0.5, 0.5, 0.5], 1)] * 3 + [(100, [0.5, -0.5, 0.5], 1), (200, None, 1), (300, [float("nan"), 0.0, 1.0], 1), (400, [None, 1.0, 1.0], 1)]
    rows += [(500, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (600, [], 1), (700, [0.25], 1), (-100, [0.0, 0.0, 0.0], 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", score int, rank int")
    assert got(mtree.top_k(df, F.col("id") % 100 == 0)) == brute(rows)
    huge = spark.createDataFrame([*rows, (800, [3e38, 0.0, 0.0], 1)], KIND)
    assert got(mtree.top_k(huge, F.col("id") % 100 == 0)) == brute(rows)
    assert got(mtree.top_k(df.limit(0), F.col("id") % 100 == 0)) == []
    assert got(mtree.top_k(df.filter("vec_id = 7"), F.col("id") % 7 == 0)) == []
    few = [r for r in rows if r[0] in (100, 200, 600)]
    assert got(mtree.top_k(spark.createDataFrame(few, KIND), F.col("id") % 100 == 0)) == brute(few)


def test_large_integers_are_exact(spark, small):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2**19 for _ in range(5)], 0) for i in range(200)]
    assert got(mtree.top_k(spark.createDataFrame(rows, KIND), F.col("id") % 50 == 0)) == brute(rows, every=50)


def test_bounds_save_distances_and_lose_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 1000
    v = np.floor(centres[rng.integers(0, 40, 4000)] + 20 * rng.normal(size=(4000, 16))).astype(np.int32)
    top = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
    pages = mtree.build(v, v[0], top)
    for p in pages:
        rows = p["rows"]
        p |= {"vectors": v[rows].astype(np.int64), "ids": rows.tolist(), "uids": rows.tolist(), "lifted": mtree.lifted(v[rows], top)}
    assert sorted(i for p in pages if p["child"] is None for i in p["rows"].tolist()) == list(range(4000))
    spent = 0
    for i in range(0, 4000, 100):
        above = mtree.distances(np.r_[v[i].astype(float), 0][None], mtree.lifted(v[:1], top))[0, 0]
        best, computed = mtree.search(pages, v[i], i, above, top, 10, None)
        spent += computed
        scores = v.astype(np.int64) @ v[i].astype(np.int64)
        want = sorted(((int(s), -j) for j, s in enumerate(scores) if j != i), reverse=True)[:10]
        assert sorted(((s, b) for s, b, _ in best), reverse=True) == want
    assert spent < 0.4 * 40 * 4000


def test_long_vectors_make_smaller_trees(spark, monkeypatch):
    for name, value in (("TREE_SIZE", 4000), ("PIVOT_SIZE", 1000), ("PACKED_SIZE", 500)):
        monkeypatch.setattr(mtree, name, value)
    rows = clustered(150, 100, 7)
    assert got(mtree.top_k(spark.createDataFrame(rows, KIND), F.col("id") % 30 == 0)) == brute(rows, every=30)
