"""Deterministic sampling, mixing, sharding and batching: every choice is a hash of ids, never a random stream."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import range_join
from strandline.operators.ranks import blocked_rank, position

#: Blocks of a seeded order: a million rows each at 10^12 rows.
BLOCKS = 1 << 20
#: Data sets of a mixture: their shares add up in one task.
MOST_SETS = 100_000


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``|``: the same on every engine and layout."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def ranked(df: DataFrame, keys: list[str], ident: str, *seed) -> DataFrame:
    """``rank`` from 0 in a seeded order inside each key, and ``total``, the key's rows."""
    u = df.withColumn("_u", hash_unit(*seed, F.col(ident)))
    return blocked_rank(u, keys, F.floor(F.col("_u") * BLOCKS), ["_u", ident]).drop("_u")


def at_most(df: DataFrame, keys: list[str], ident: str, n: int, *seed) -> DataFrame:
    """At most ``n`` rows of each key, without replacement."""
    return ranked(df, keys, ident, *seed).filter(F.col("rank") < n).drop("rank", "total")


def mixture_draws(weights: DataFrame, name: str, weight: str, draws: int, seed: int) -> DataFrame:
    """(draw, name): each draw takes a data set with its share of the weights.

    A draw is a number in [0, 1) and looks for the share that holds it in its bucket of the unit interval: there are
    as many buckets as data sets, so a bucket has few shares and a share few buckets on average.
    """
    count, total = weights.agg(F.count("*"), F.sum(weight)).first()
    if not count:
        return weights.sparkSession.createDataFrame([], f"draw long, {name} {dict(weights.dtypes)[name]}")
    if count > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} data sets in a mixture")
    w = Window.orderBy(name)
    shares = weights.select(name, (F.sum(weight).over(w) / total).alias("_hi"), ((F.sum(weight).over(w) - F.col(weight)) / total).alias("_lo"))
    u = weights.sparkSession.range(draws).select(F.col("id").alias("draw"), hash_unit(seed, F.col("id")).alias("_u"))
    return range_join(u, "_u", shares, "_lo", "_hi", 1.0 / count).select("draw", name)


def fractional_repeat(df: DataFrame, ident: str, frequency: float, *seed) -> DataFrame:
    """Whole copies of every row, then one more of the first ceil(n frac) in seeded order; ``copy`` counts from 0."""
    whole, frac = int(frequency), frequency - int(frequency)
    r = ranked(df, [], ident, *seed).withColumn("_more", (F.col("rank") < F.ceil(F.col("total") * frac)).cast("int"))
    return r.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), F.lit(whole)), lambda i: i < whole + F.col("_more")))).drop("_more", "rank", "total")


def allocate(weights: DataFrame, name: str, weight: str, total: int, least: int = 1) -> DataFrame:
    """Integer parts of ``total`` by weight, ``least`` for each first, largest remainders take the rest."""
    everyone = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everyone)
    exact = F.col(weight) / F.sum(weight).over(everyone) * (F.lit(total) - least * n)
    a = weights.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    a = a.withColumn("_rest", F.lit(total) - least * F.count("*").over(everyone) - F.sum("_f").over(everyone))
    a = a.withColumn("_r", F.row_number().over(everyone.orderBy((F.col("_x") - F.col("_f")).desc(), name)))
    return a.select(name, (F.col("_f") + least + (F.col("_r") <= F.col("_rest")).cast("int")).cast("long").alias("part"))


def rank_split(df: DataFrame, order: str, world: int, pad: bool) -> DataFrame:
    """(rank, place): rows dealt to ``world`` ranks in turn; the tail is dropped, or padded from the front."""
    r = position(df, order, name="_p", total="_n")
    if pad:
        more = F.pmod(-F.col("_n"), F.lit(world))
        r = r.withColumn("_p", F.explode(F.when(F.col("_p") < more, F.array("_p", F.col("_n") + F.col("_p"))).otherwise(F.array("_p"))))
    else:
        r = r.filter(F.col("_p") < F.col("_n") - F.pmod(F.col("_n"), F.lit(world)))
    return r.withColumn("rank", (F.col("_p") % world).cast("long")).withColumn("place", F.floor(F.col("_p") / world)).drop("_p", "_n")


def fixed_batches(df: DataFrame, keys: list[str], ident: str, size: int, *seed) -> DataFrame:
    """``batch`` and ``slot`` inside each key, in seeded order."""
    r = ranked(df, keys, ident, *seed)
    return r.withColumn("batch", F.floor(F.col("rank") / size)).withColumn("slot", F.col("rank") % size).drop("rank", "total")


def group_batches(df: DataFrame, document: str, task: str, ident: str, groups: int, queries: int, seed: int, epoch: int) -> DataFrame:
    """Guidance-first batches: (batch, document, query slot, sample, valid).

    Documents come in seeded order, ``groups`` a batch; the last short batch is dropped. Each document gets ``queries``
    distinct samples of its task: those at places document rank x queries ... of the task's seeded cycle, wrapping
    around. A task with fewer samples leaves slots invalid.
    """
    docs = ranked(df.select(document, task).distinct(), [], document, seed, epoch)
    docs = docs.withColumn("batch", F.floor(F.col("rank") / groups)).filter(F.col("batch") < F.floor(F.col("total") / groups)).drop("total", "rank")
    docs = blocked_rank(docs, [task], F.floor(F.col("batch") / BLOCKS), ["batch", document], "_turn", "_turns").drop("_turns")
    samples = ranked(df.select(F.col(task).alias("_task"), F.col(ident).alias("sample")), ["_task"], "sample", seed, epoch, "cycle").drop("total")
    sizes = samples.groupBy("_task").agg(F.count("*").alias("_size"))
    asked = docs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    asked = asked.join(sizes, F.col(task) == F.col("_task")).drop("_task").withColumn("valid", F.col("slot") < F.col("_size"))
    asked = asked.withColumn("_at", F.when(F.col("valid"), (F.col("_turn") * queries + F.col("slot")) % F.col("_size")))
    found = asked.join(samples, (F.col(task) == F.col("_task")) & (F.col("_at") == F.col("rank")), "left")
    return found.select("batch", document, task, F.col("slot").cast("long").alias("slot"), "sample", "valid")


class Waiting:
    """Items that wait, in order of arrival. A tournament tree over their sizes finds the first one at or behind a place
    that is small enough, in time logarithmic in their number."""

    def __init__(self, leaves: int = 64):
        self.live = self.total = 0
        self._clear(leaves)

    def _clear(self, leaves: int) -> None:
        self._leaves, self._end, self._items = leaves, 0, [None] * leaves
        self._least = [math.inf] * (2 * leaves)

    def _set(self, place: int, size: float) -> None:
        least, i = self._least, place + self._leaves
        least[i] = size
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def add(self, item, size: int) -> None:
        if self._end == self._leaves:  # only what still waits moves, to twice its room
            kept = [(x, s) for x, s in zip(self._items, self._least[self._leaves :]) if s < math.inf]
            self.live = self.total = 0
            self._clear(max(64, 1 << (2 * len(kept)).bit_length()))
            for x, s in kept:
                self.add(x, s)
        self._items[self._end] = item
        self._set(self._end, size)
        self._end, self.live, self.total = self._end + 1, self.live + 1, self.total + size

    def first(self, place: int, limit: float) -> int:
        """The first place from here on whose size is at most ``limit``, or -1."""
        if place >= self._leaves:
            return -1
        least, i = self._least, place + self._leaves
        while least[i] > limit or least[i] == math.inf:
            while i & 1:
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self._leaves:
            i = 2 * i if least[2 * i] <= limit and least[2 * i] < math.inf else 2 * i + 1
        return i - self._leaves

    def take(self, place: int):
        size = self._least[place + self._leaves]
        self._set(place, math.inf)
        self.live, self.total = self.live - 1, self.total - size
        return self._items[place], size

    def batch(self, budget: int) -> list:
        """The first item, whatever its size, and each later one that still fits, until the budget is used up."""
        items, used, place = [], 0, 0
        while used < budget:
            place = self.first(place, budget - used if used else math.inf)
            if place < 0:
                break
            item, size = self.take(place)
            items.append(item)
            used, place = used + size, place + 1
        return items


def budget_batches(df: DataFrame, keys: list[str], order: str, size: str, budget: int, buffer: int = 500) -> DataFrame:
    """(keys, order, batch): items of a key in order of ``order``, first fit into batches of at most ``budget``.

    Items wait in a buffer. Once it holds ``buffer`` items and ``budget`` in all, and again before each further item, a
    batch takes the first item that waits, whatever its size, and then every later one that fits in what is left; the
    others wait for later batches. At the end batches are formed until nothing waits. A null size is none.

    The rule goes by what came before, so a key is read by one task; as loaders do it, make the worker a part of the key
    to spread a large one. A task remembers the waiting items: ``buffer`` of them, or as many as it takes to reach the
    budget.
    """

    def run(batches):
        now, waiting, number, done = None, Waiting(), 0, []

        def form():
            nonlocal number
            done.extend((*now, item, number) for item in waiting.batch(budget))
            number += 1

        def packed():
            columns = list(zip(*done)) or [[]] * (len(keys) + 2)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        names, types = [*keys, order, "batch"], None
        for batch in batches:
            types = types or [*batch.schema.types[:-1], pa.int64()]
            lists = [batch.column(i).to_pylist() for i in range(len(keys) + 2)]
            for *key, item, n in zip(*lists):
                if key != now:
                    while waiting.live:
                        form()
                    now, number = key, 0
                elif waiting.live >= buffer and waiting.total >= budget:
                    form()
                waiting.add(item, n)
            yield packed()
        while waiting.live:
            form()
        if types:
            yield packed()

    kinds = dict(df.dtypes)
    rows = df.select(*keys, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + ", batch long"
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def greedy_balance(df: DataFrame, order: str, ident: str, size: str, shards: int) -> DataFrame:
    """(ident, shard, before): items in order, each to the shard that is shortest so far (the first of equals).

    Each choice depends on all before it, so one task reads (ident, size) in order; it remembers ``shards`` numbers.
    The rows come to it by an exchange, so what makes them still runs on all tasks.
    Items are whole episodes or files, not their rows.
    """

    def run(batches):
        heap = [(0, s) for s in range(shards)]
        for batch in batches:
            shard, before = [], []
            for n in batch.column(1).to_pylist():
                used, s = heapq.heappop(heap)
                shard.append(s)
                before.append(used)
                heapq.heappush(heap, (used + n, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int64()), pa.array(before, pa.int64())], [ident, "shard", "before"])

    kind = dict(df.dtypes)[ident]
    items = df.select(order, F.col(ident), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).repartition(1).sortWithinPartitions(order, ident)
    return items.select(ident, "_size").mapInArrow(run, f"{ident} {kind}, shard long, before long")
