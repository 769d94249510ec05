import itertools
import random
import zlib

from pyspark.sql import functions as F

from strandline.llm import reshard


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(20):
        sizes = {i: rng.randrange(50) for i in range(rng.randrange(1, 5))}
        caps = reshard.equal_capacities(sum(sizes.values()), rng.randrange(1, 5))
        plan = reshard.moves(sizes, caps)
        moved = sum(f for i, parts in plan.items() for j, f in parts if i != j)
        assert moved == sum(max(0, s - (caps[i] if i < len(caps) else 0)) for i, s in sizes.items())
        assert all(sum(f for _, f in plan[i]) == s for i, s in sizes.items())
        cost = [[int(i != j) for j in range(len(caps))] for i in sizes]
        flow = reshard.min_cost_flow([sizes[i] for i in sizes], caps, cost)
        assert moved == sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr))
        kept = reshard._kept_moves(sizes, caps)
        assert moved == sum(f for i, parts in kept.items() for j, f in parts if i != j)
        assert all(sum(f for _, f in kept[i]) == s for i, s in sizes.items()) and all(p[0][0] == i for i, p in plan.items() if any(j == i for j, _ in p))
        assert [sum(f for parts in plan.values() for j, f in parts if j == k) for k in range(len(caps))] == caps


def test_flow_against_brute_force_costs():
    cost = [[4, 1, 7], [2, 6, 3]]
    flow = reshard.min_cost_flow([2, 2], [1, 2, 1], cost)
    got = sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr))
    units = [0, 0, 1, 1]
    best = min(sum(cost[units[k]][d] for k, d in enumerate(p)) for p in itertools.permutations([0, 1, 1, 2]))
    assert got == best


def make_rows():
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(60), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    rows += [(700, None, None), (701, "", "hot"), (701, "", "hot"), (702, "x" * 5000, "hot"), (1, "other text", "s1"), (1, None, "hot")]
    return rows + [(None, "one", "s2"), (None, "two", "hot"), (None, None, "s2"), (703, "long " * 300_000, "s3")]


def stored(r):
    data = (r[1] or "").encode()
    return r[0] or -1, len(data) + 1, zlib.crc32(data)


def test_query_reads_the_rewritten_files(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, shard int, slot int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = reshard.op9(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(map(stored, rows))
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_come_near_the_capacities(spark, tmp_path):
    rows = make_rows()[:-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    old = reshard.write_shards(docs, F.pmod(F.xxhash64("source"), F.lit(5)), str(tmp_path / "old"))
    got = reshard.reshard(reshard.read_shards(spark, old, docs), 4).collect()
    total = {s: sum(r.size for r in got if r.shard == s) for s in range(4)}
    assert len(got) == len(rows) and max(total.values()) - min(total.values()) <= 2 * 5001
    least = sum(max(0, sum(r.size for r in got if r.old_shard == i) - (sum(total.values()) // 4 if i < 4 else 0)) for i in range(5))
    assert sum(r.size for r in got if r.old_shard != r.shard) <= least + 5 * 5001


def test_rewriting_a_live_set_touches_affected_shards_only(spark, tmp_path):
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    old = reshard.write_shards(docs, F.coalesce(F.col("doc_id") % 4, F.lit(2)), str(tmp_path / "old"))
    live = reshard.read_shards(spark, old, docs)
    sizes = {r[0]: r[1] for r in live.groupBy("_shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).collect()}
    # shards 0 and 3 keep what they have, 1 gives to 2 and to a new one
    capacities = [sizes[0], sizes[1] - 900, sizes[2] + 400, sizes[3], 500]
    assigned = reshard.reshard(live, 5, capacities)
    new = reshard.rewrite(spark, old, docs, assigned, str(tmp_path / "new"))
    assert new[0] == old[0] and new[3] == old[3] and all("new" in new[i] for i in (1, 2, 4))
    made = reshard.read_shards(spark, new, docs).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.source) for r in made), key=key) == sorted(rows, key=key)
    assert {r._row: r._shard for r in made} == {r._row: r.shard for r in assigned.collect()} and len({r._row for r in made}) == len(rows)
    # the old set is still there
    assert reshard.read_shards(spark, old, docs).count() == len(rows)
    # emptying a shard leaves no folder of it
    total = sum(sizes.values())
    less = reshard.rewrite(spark, new, docs, reshard.reshard(reshard.read_shards(spark, new, docs), 3, [total - 20, 10, 10]), str(tmp_path / "less"))
    assert set(less) <= {0, 1, 2} and reshard.read_shards(spark, less, docs).count() == len(rows)
    assert str(less[0]) in reshard.describe(less)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert reshard.op9(spark, str(tmp_path)).count() == 0


def test_thousands_of_shards_are_one_scan(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text"), F.lit("s").alias("source"))
    old = reshard.write_shards(docs.coalesce(1), F.col("doc_id") % 500, str(tmp_path / "old"))
    live = reshard.read_shards(spark, old, docs)
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and {r._shard for r in live.select("_shard").distinct().collect()} == set(range(500))
    got = reshard.reshard(live, 2000).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    assert sum(r["size"] for r in got) == sum(1 + i % 9 for i in range(3000)) and max(r["size"] for r in got) <= 8 + 2 * 9


def test_small_documents_make_equal_shards(spark, tmp_path):
    """Shards are within one hundredth where documents are small against them."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7 % 60).cast("int")).alias("text"), F.lit("s").alias("source"))
    old = reshard.write_shards(docs, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 16), str(tmp_path / "old"))
    sizes = [r["size"] for r in reshard.reshard(reshard.read_shards(spark, old, docs), 16).groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16
