"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new capacities are demands, and a byte costs one unit unless it stays where it is. The
flow says how many bytes go from each old shard to each new one. Every old shard is a line of blocks; its line is cut
at the flow's amounts, whole blocks between two cuts move as they are and only blocks that a cut meets are split
between documents. The driver sees shard sizes only; block offsets and ranks are windows over bounded groups.

A *shard set* is a folder of files for each shard, whose rows carry a number of their own (``_row``). Rewriting a set
writes new folders for the shards that lose or gain rows and leaves all other folders, and the old set, untouched.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandline.llm._shared import fresh_path, remove, scratch, written

#: Rows that a block is meant to hold, and the most blocks that a shard is cut into (so block tables stay bounded; 256
#: at least).
BLOCK_ROWS, MOST_BLOCKS = 20_000, 4096
#: Pairs of an old and a new shard of which a flow is solved.
SOLVED = 4096


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from supplies to demands (equal sums) at least cost, by successive shortest paths."""
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    while any(left):
        # Bellman-Ford over sources (0..n-1) and sinks (n..n+m-1) of the residual graph
        dist = [0 if x else None for x in left] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]):
                        dist[n + j], came[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                        dist[i], came[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((n + j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda x: dist[x])
        path, x = [], end
        while came[x] is not None:
            path.append((came[x], x))
            x = came[x]
        amount = min([left[x], room[end - n], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[x] -= amount
        room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def moves(sizes: dict[int, int], capacities: list[int], cost: list[list[int]] | None = None) -> dict[int, list[tuple[int, int]]]:
    """Old shard -> [(new shard, bytes)], what stays first: the cheapest flow from sizes to capacities.

    ``cost`` has a row for each old shard in order and a column for each new one; without it staying is free and every
    other way costs one, so that the fewest bytes change shards. With up to ``SOLVED`` pairs of shards, or with a cost,
    the flow is solved. For more pairs of one price it is told directly: a flow is cheapest exactly if each shard keeps
    as many bytes as it may, whoever gets what is over.
    """
    old = sorted(sizes)
    if cost is None and len(old) * len(capacities) > SOLVED:
        return _kept_moves(sizes, capacities)
    cost = cost or [[int(i != j) for j in range(len(capacities))] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], list(capacities), cost)
    return {i: sorted(((j, f) for j, f in enumerate(row) if f), key=lambda p, i=i: (p[0] != i, p[0])) for i, row in zip(old, flow)}


def _kept_moves(sizes: dict[int, int], capacities: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Each shard keeps what it may; what is over goes to whoever has room, in order of shards."""
    plan: dict[int, list[tuple[int, int]]] = {}
    room, over = list(capacities), []
    for i in sorted(sizes):
        stays = min(sizes[i], room[i]) if 0 <= i < len(room) else 0
        plan[i] = [(i, stays)] if stays else []
        if stays:
            room[i] -= stays
        over.append((i, sizes[i] - stays))
    j = 0
    for i, amount in over:
        while amount:
            while not room[j]:
                j += 1
            part = min(amount, room[j])
            plan[i].append((j, part))
            amount, room[j] = amount - part, room[j] - part
    return plan


def write_shards(docs: DataFrame, shard: Column, path: str) -> dict[int, str]:
    """Write ``docs`` as a shard set under ``path``: shard (an integer from 0; null counts as 0) -> folder."""
    numbered = docs.withColumns({"_shard": F.coalesce(shard.cast("int"), F.lit(0)), "_row": F.monotonically_increasing_id()})
    numbered.write.partitionBy("_shard").option("compression", "zstd").parquet(path)
    return _folders(docs.sparkSession, path)


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [f.getPath().getName() for f in found]
    return {int(n.removeprefix("_shard=")): f"{path}/{n}" for n in names if n.startswith("_shard=")}


def read_shards(spark: SparkSession, folders: dict[int, str], like: DataFrame) -> DataFrame:
    """All rows of a shard set with ``_row`` and ``_shard``; ``like`` has the columns (of another set or of its table)."""
    schema = StructType([StructField(f.name, f.dataType) for f in like.schema.fields if f.name not in ("_row", "_shard")]).add("_row", LongType())
    schema = schema.add("_shard", IntegerType())
    sets = defaultdict(list)
    for _, folder in sorted(folders.items()):
        sets[folder.rsplit("/", 1)[0]].append(folder)
    # one scan for all folders of a set that were written together: the folder's name tells the shard
    parts = [spark.read.schema(schema).option("basePath", root).parquet(*found) for root, found in sorted(sets.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def reshard(rows: DataFrame, shards: int, capacities: list[int] | None = None, text_col: str = "text") -> DataFrame:
    """(_row, size, text_crc32, old_shard, shard, slot) for every row of a shard set (``_row``, ``_shard`` and the text).

    ``capacities`` are bytes per new shard and must add up to the total (by default equal). A size is the UTF-8 bytes of
    the text (null: none) plus one; texts of any length are sized where they are read. A cut falls at the nearest end of a
    document, so a shard misses its capacity by half a document at most for each cut of a part that it takes. Slots number each shard's
    rows from 0, in no order that means anything. Repeated rows are rows each; empty input gives an empty result. No
    other column is read, so names can't clash.
    """
    with scratch(rows.sparkSession) as keep:
        text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
        light = written(
            rows.select("_row", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("_shard").alias("old_shard")),
            "reshard-rows",
        )
        by_shard = {r.old_shard: (r.size, r.n) for r in light.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        total = sum(size for size, _ in by_shard.values())
        plan = moves({i: size for i, (size, _) in by_shard.items()}, capacities or equal_capacities(total, shards))
        n_blocks = int(min(MOST_BLOCKS, max(256, max([n for _, n in by_shard.values()], default=0) // BLOCK_ROWS)))
        placed = light.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int"))
        line = Window.partitionBy("old_shard").orderBy("block")
        blocks = placed.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).select("old_shard", "block", (F.sum("bytes").over(line) - F.col("bytes")).alias("start"))
        cuts = []
        for i, parts in plan.items():
            at = 0
            for j, amount in parts:
                cuts.append((i, at, at + amount, j))
                at += amount
        cut_rows = rows.sparkSession.createDataFrame(cuts, "old_shard int, lo long, hi long, shard int")
        # a block with the cuts that it meets: two tables of shards x MOST_BLOCKS and of old + new shards rows at most
        ends = blocks.withColumn("end", F.coalesce(F.lead("start").over(line), F.lit((1 << 63) - 1)))
        meets = ends.join(cut_rows, ["old_shard"]).filter("lo < end and hi > start")
        blocks = meets.groupBy("old_shard", "block", "start").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("cuts"))
        inside = Window.partitionBy("old_shard", "block").orderBy("_row")
        spread = placed.join(blocks, ["old_shard", "block"])
        spread = spread.withColumn("pos", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        # a document goes where its middle lies
        middle = F.col("pos") + F.floor(F.col("size") / 2)
        spread = spread.withColumn("shard", F.filter("cuts", lambda c: (c["lo"] <= middle) & (middle < c["hi"]))[0]["shard"])
        rank = F.row_number().over(Window.partitionBy("old_shard", "block", "shard").orderBy("_row")) - 1
        ranked = written(spread.select("_row", "size", "text_crc32", "old_shard", "block", "shard", rank.alias("rank")), "reshard-ranked")
        order = Window.partitionBy("shard").orderBy("old_shard", "block")
        bases = ranked.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n")).select("shard", "old_shard", "block", (F.sum("n").over(order) - F.col("n")).alias("base"))
        done = ranked.join(bases, ["shard", "old_shard", "block"])
        return keep(done.select("_row", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot")), "assigned")


def rewrite(spark: SparkSession, folders: dict[int, str], like: DataFrame, assigned: DataFrame, path: str) -> dict[int, str]:
    """The shard set after ``assigned`` (see ``reshard``): shards that lose or gain rows are written anew under ``path``,
    the folders of all others stay what they are. Nothing is overwritten or deleted; an emptied shard has no folder."""
    moved = assigned.filter("old_shard <> shard")
    # at most all shards
    touched = {r.s for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()}
    if not touched:
        return dict(folders)
    old = read_shards(spark, {i: f for i, f in folders.items() if i in touched}, like)
    places = assigned.filter(F.col("shard").isin(sorted(touched))).select("_row", "shard")
    found = old.drop("_shard").join(places.hint("merge"), "_row").withColumnRenamed("shard", "_shard")
    found.write.partitionBy("_shard").option("compression", "zstd").parquet(path)
    return {i: f for i, f in folders.items() if i not in touched} | _folders(spark, path)


def describe(folders: dict[int, str]) -> str:
    """A shard set as one JSON line, to be put in the place of the old one's once all is written."""
    return json.dumps({str(i): f for i, f in sorted(folders.items())})


def op9(spark, root):
    """Query op9_reshard: from 16 shards by source to 16 shards of equal bytes, read back from the rewritten files. Both
    shard sets go once their rows are told."""
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "source")
    paths = fresh_path(spark, "shards"), fresh_path(spark, "shards")
    with scratch(spark) as keep:
        old = write_shards(docs, F.pmod(F.xxhash64("source"), F.lit(16)), paths[0])
        assigned = reshard(read_shards(spark, old, docs), 16)
        new = read_shards(spark, rewrite(spark, old, docs, assigned, paths[1]), docs)
        text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        stored = new.select("_row", "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("_shard").alias("shard"))
        slots = assigned.select("_row", F.col("shard").alias("_due"), "slot")
        shard = F.when(F.col("shard") == F.col("_due"), F.col("shard")).otherwise(F.raise_error(F.lit("a row is in a shard that it was not assigned to")).cast("int"))
        rows = stored.join(slots, "_row").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
        rows = keep(rows, "resharded")
        remove(spark, list(paths))
        return rows
