"""Exact quantiles against NumPy: keys that a sketch holds whole and keys whose ranks lie between edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import stats

ASKED = {"low": 0.0, "q01": 0.01, "mid": 0.5, "q95": 0.95, "top": 1.0}


def answers(spark, frame, keys, **more):
    rows = stats.exact_quantiles(frame, "x", keys, ASKED, **more).collect()
    return {tuple(r[k] for k in keys): [r[name] for name in ASKED] for r in rows}


def expected(values):
    s = np.sort(np.array(values, float))
    out = []
    for p in ASKED.values():
        at = p * (len(s) - 1)
        a, b, part = s[math.floor(at)], s[math.ceil(at)], at - math.floor(at)
        out.append(a if part == 0 else (1 - part) * a + part * b)
    return out


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_keys_of_every_size_and_a_null_key(spark, accuracy):
    rng = np.random.default_rng(2)
    made = {"one": [3.0], "two": [1.0, -2.0], "ties": [5.0] * 7 + [6.0] * 2, None: rng.normal(size=301).tolist(), "hot": rng.normal(size=6000).tolist(), "few values": rng.integers(0, 3, 5000).astype(float).tolist()}
    rows = [(k, float(x)) for k, xs in made.items() for x in xs] + [("one", None), ("nothing", None)]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[i] for i in order], "k string, x double").repartition(7)
    assert answers(spark, frame, ["k"], accuracy=accuracy) == {(k,): expected(xs) for k, xs in made.items()}


def test_a_key_beyond_the_sketch(spark):
    frame = spark.range(0, 60_000, 1, 5).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"), F.lit("a").alias("k"))
    values = [r.x for r in frame.collect()]
    assert answers(spark, frame, ["k"]) == {("a",): expected(values)}
    assert answers(spark, frame, []) == {(): expected(values)}


def test_an_empty_table_has_no_row(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert answers(spark, empty, ["k"]) == {} and answers(spark, empty, []) == {}


def test_rows_are_read_twice(spark):
    frame = spark.range(0, 200_000, 1, 4).select(F.rand(1).alias("x"), (F.col("id") % 2).alias("k"))
    out = stats.exact_quantiles(frame, "x", ["k"], {"mid": 0.5})
    assert all(abs(r["mid"] - 0.5) < 0.01 for r in out.collect())
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # once for the edges, once for the counts, which both uses share
    assert final.count("Range (") == 2 and "ReusedExchange" in final and "NestedLoop" not in final
