"""First-fit token batches against a plain loop over a buffer."""

import random

import pytest

from strandline.operators import sampling


def brute(items, budget, buffer):
    waiting, batches = [], []

    def form():
        used, taken, left = 0, [], []
        for item, size in waiting:
            if used < budget and (used == 0 or size <= budget - used):
                used += size
                taken.append(item)
            else:
                left.append((item, size))
        waiting[:] = left
        batches.append(taken)

    for item, size in items:
        if waiting and len(waiting) >= buffer and sum(s for _, s in waiting) >= budget:
            form()
        waiting.append((item, size))
    while waiting:
        form()
    return batches


def found(spark, rows, budget, buffer):
    df = spark.createDataFrame(rows, "key string, item long, size long").repartition(3)
    out = {}
    for r in sampling.budget_batches(df, ["key"], "item", "size", budget, buffer).collect():
        out.setdefault(r.key, {}).setdefault(r.batch, []).append(r.item)
    return {k: [sorted(b[i]) for i in range(len(b))] for k, b in out.items()}


def test_an_item_that_does_not_fit_waits(spark):
    rows = [("a", i, n) for i, n in enumerate((6, 8, 4, 2))]
    assert found(spark, rows, 10, 4) == {"a": [[0, 2], [1, 3]]}


@pytest.mark.parametrize("seed,buffer", [(1, 1), (2, 7), (3, 40)])
def test_batches_match_the_loop(spark, seed, buffer):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([0, 1, 3, 9, 20, 55, 130])) for k in "abc" for i in range(rng.choice((1, 90, 400)))]
    want = {k: brute([r[1:] for r in rows if r[0] == k], 60, buffer) for k in "abc"}
    assert found(spark, rows, 60, buffer) == want


def test_nulls_and_empty_tables(spark):
    rows = [(None, 1, None), (None, 2, 70), (None, 3, 5), ("a", 4, 0)]
    assert found(spark, rows, 60, 2) == {None: brute([(1, 0), (2, 70), (3, 5)], 60, 2), "a": [[4]]}
    assert found(spark, [], 60, 2) == {}


def test_a_long_wait_takes_no_quadratic_time():
    waiting, taken = sampling.Waiting(), 0
    for i in range(60_000):
        waiting.add(i, 7 if i % 2 else 6)
    while waiting.live:
        taken += len(waiting.batch(12))
    assert taken == 60_000


def test_mixture_draws_follow_the_shares(spark):
    weights = spark.createDataFrame([(f"s{i:03d}", float(i % 5)) for i in range(300)], "name string, w double")
    draws = sampling.mixture_draws(weights, "name", "w", 20_000, 7)
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = {r["name"]: r["count"] for r in draws.groupBy("name").count().collect()}
    assert sum(counts.values()) == 20_000 and not any(int(n[1:]) % 5 == 0 for n in counts)
    assert abs(sum(v for n, v in counts.items() if int(n[1:]) % 5 == 4) / 20_000 - 0.4) < 0.02
