"""Statistics of vectors and scalars: exact, mergeable, histogram-based, weighted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scans import running, runnings


def long_form(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row per element: keys, ``dim`` from 0, ``x`` double."""
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def exact_quantiles(df: DataFrame, value: str, keys: list[str], named: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(keys, one column for each name): exact quantiles, linear between neighbours; no row where a key has no value.

    A large group never meets in one task, and rows are read twice. A sketch gives an edge on either side of each wanted
    quantile, at four times the sketch's error. Then values between such edges (about 8 / ``accuracy`` of the rows) and
    all values of keys with less than 2 x ``accuracy`` rows, which the sketch holds whole as well, are counted one by
    one, and what lies between the edges of neighbours is counted as a whole. Running counts of those give the ranks.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    shares = [min(1.0, max(0.0, p + side * 4 / accuracy)) for p in named.values() for side in (-1, 1)]
    edges = rows.groupBy(*keys).agg(F.percentile_approx("_v", shares, accuracy).alias("_edges"), F.count("*").alias("_all_n"))
    edge, v = [F.get("_edges", F.lit(i)) for i in range(len(shares))], F.col("_v")
    near = reduce(lambda a, b: a | b, [(edge[i] <= v) & (v <= edge[i + 1]) for i in range(0, len(shares), 2)], F.col("_all_n") < 2 * accuracy)
    # rises with the value, and parts the values at an edge from those on its sides
    region = reduce(lambda a, b: a + b, [(e < v).cast("int") + (e <= v).cast("int") for e in edge])
    counts = _met(rows, edges, keys).select(*keys, region.alias("_region"), F.when(near, v).alias("_near"))
    counts = counts.groupBy(*keys, "_region", "_near").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    regions = counts.groupBy(*keys, "_region").agg(F.sum("_n").alias("_sum"))
    regions = regions.select(*keys, "_region", (F.sum("_sum").over(whole.orderBy("_region")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(whole).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_region").orderBy("_near"))
    ranked = _met(counts.withColumn("_upto", upto), regions, [*keys, "_region"]).withColumn("_to", F.col("_before") + F.col("_upto"))
    found = F.coalesce("_near", F.raise_error(F.lit("a sketch of quantiles is further off than its error")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to")), found))

    place = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in named.items()}
    ends = ranked.groupBy(*keys).agg(*[c for i, x in enumerate(place.values()) for c in (at(F.floor(x)).alias(f"_a{i}"), at(F.ceil(x)).alias(f"_b{i}"))], F.first("_total").alias("_total"))
    part = {name: x - F.floor(x) for name, x in place.items()}
    linear = [F.when(part[name] == 0, F.col(f"_a{i}")).otherwise((1 - part[name]) * F.col(f"_a{i}") + part[name] * F.col(f"_b{i}")).alias(name) for i, name in enumerate(named)]
    return ends.select(*keys, *linear).drop("_all")


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key; null keys are equal."""
    named = table.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)])
    return rows.join(named, same).drop(*[f"_key{i}" for i in range(len(keys))])


def vector_stats(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Exact per-dimension count, mean, population deviation, min, max, and linear 1 % and 99 % quantiles."""
    rows, on = long_form(df, vector, *keys), [*keys, "dim"]
    plain = rows.groupBy(*on).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return plain.join(exact_quantiles(rows, "x", on, {"q01": 0.01, "q99": 0.99}), on, "left")


def config_key(settings: dict[str, Column]) -> Column:
    """One text for equal settings: names in lower case and in order, values trimmed and in lower case, nulls kept."""
    parts = [F.concat(F.lit(f"{name.lower()}="), F.coalesce(F.lower(F.trim(value.cast("string"))), F.lit("null"))) for name, value in sorted(settings.items(), key=lambda x: x[0].lower())]
    return F.concat_ws("|", *parts)


def stats_cache(entries: DataFrame, config: str, made: str, values: list[str]) -> DataFrame:
    """(config, made, values): the newest entry of each configuration."""
    return entries.groupBy(config).agg(F.max(made).alias(made), *[F.max_by(v, made).alias(v) for v in values])


def batch_ranges(df: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """(key, batch, lo, hi, grown, k): the range of all values up to each batch, whether the batch made it grow, and the
    number of its last growth, from 0.

    Batches are integers from 0; running ranges are scans over blocks of batches.
    """
    per = df.groupBy(key, batch).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    low, high = -F.col("_lo"), F.col("_hi")
    runs = runnings(per, [key], batch, {"_low": (low, True, True), "hi": (high, True, True), "_old_low": (low, True, False), "_old_hi": (high, True, False)})
    grown = F.col("_old_hi").isNull() | (F.col("_old_low") != F.col("_low")) | (F.col("_old_hi") != F.col("hi"))
    runs = runs.select(key, batch, (-F.col("_low")).alias("lo"), "hi", grown.alias("grown"))
    return running(runs, [key], batch, F.col("grown").cast("int"), "k").withColumn("k", (F.col("k") - 1).cast("int"))


def range_changes(df: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """(key, k, batch, lo, hi): the batches at which the range of all values so far grows, numbered from 0 in each key."""
    return batch_ranges(df, key, batch, value).filter("grown").select(key, "k", batch, "lo", "hi")


def _edge(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The left edge of the value's bin."""
    at = F.greatest(F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)), F.lit(0))
    return F.when(hi > lo, lo + at * (hi - lo) / bins).otherwise(lo)


def adaptive_histogram(df: DataFrame, key: str, batch: str, value: str, bins: int = 5000) -> DataFrame:
    """(key, edge, n): the histogram of values that come batch by batch into ``bins`` equal bins whose range grows.

    A batch that widens the range of its key first moves what is there: each old bin's count goes to the new bin that
    holds the old one's left edge. Where a value ends thus depends on its batch and on the later widenings only, and
    those are few, so batches are counted in parallel and each (widening, bin) is moved on its own.
    """
    ranges = batch_ranges(df, key, batch, value)
    listed = ranges.filter("grown").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", batch, "lo", "hi"))).alias("_c"))
    # the range when a batch comes
    rows = df.select(key, batch, value).join(ranges.select(key, batch, F.col("k").alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), [key, batch])
    counted = rows.groupBy(key, "_k", _edge(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("edge")).agg(F.count("*").alias("n"))
    later = F.filter("_c", lambda c: c["k"] > F.col("_k"))
    moved = counted.join(listed, key).withColumn("edge", F.aggregate(later, F.col("edge"), lambda at, c: _edge(at, c["lo"], c["hi"], bins)))
    return moved.groupBy(key, "edge").agg(F.sum("n").alias("n"))


def left_edge_quantiles(hist: DataFrame, key: str, quantiles: list[float]) -> DataFrame:
    """(key, q, value): left edge of the first bin at which the running count reaches q n; keys of two values or more."""
    seen = F.sum("n").over(Window.partitionBy(key).orderBy("edge"))
    run = hist.withColumn("_seen", seen).withColumn("_total", F.sum("n").over(Window.partitionBy(key))).filter("_total >= 2")
    asked = run.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).filter(F.col("_seen") >= F.col("q") * F.col("_total"))
    return asked.groupBy(key, "q").agg(F.min("edge").alias("value"))


def as_vectors(stats: DataFrame, *names: str) -> DataFrame:
    """One row with an array per statistic, in order of ``dim``; as wide as a vector, so small enough to broadcast."""
    sorted_rows = F.sort_array(F.collect_list(F.struct("dim", *names)))
    return stats.agg(sorted_rows.alias("s")).select(*[F.col("s").getField(n).alias(n) for n in names])


def moments(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Mergeable state: count, sum, sum of squares, min, max."""
    v = value.cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merge_moments(states: DataFrame, *keys: str) -> DataFrame:
    """States of any partition of the rows merged into one per key."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def finish_moments(states: DataFrame) -> DataFrame:
    mean = F.col("s1") / F.col("n")
    return states.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))))


def merge_grouped(stats: DataFrame, *keys: str) -> DataFrame:
    """Per-episode (n, mean, var, min, max) to one row per key: weighted mean, variance with the spread of the means."""
    total = stats.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("all_mean")) if keys else None
    if total is None:
        total = stats.agg(F.sum("n").alias("total"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("all_mean"))
        joined = stats.crossJoin(F.broadcast(total))  # one row
    else:
        joined = stats.join(total, list(keys))
    spread = (F.col("var") + (F.col("mean") - F.col("all_mean")) ** 2) * F.col("n") / F.col("total")
    return joined.groupBy(*keys).agg(F.first("total").alias("n"), F.first("all_mean").alias("mean"), F.sum(spread).alias("var"), F.min("min").alias("min"), F.max("max").alias("max"))


def weighted_merge(stats: DataFrame, weight: str) -> DataFrame:
    """Over data sets: weighted mean, variance and (approximate by design) quantiles; least min, greatest max."""
    w = F.col(weight)
    mean = F.sum(w * F.col("mean")) / F.sum(w)
    second = F.sum(w * (F.col("std") ** 2 + F.col("mean") ** 2)) / F.sum(w)
    return stats.agg(
        mean.alias("mean"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum(w * F.col("q01")) / F.sum(w)).alias("q01"),
        (F.sum(w * F.col("q99")) / F.sum(w)).alias("q99"),
    )


def histogram(df: DataFrame, value: str, key: str, bins: int) -> DataFrame:
    """(key, bin, n, lo, hi): counts of equal bins between each key's least and greatest value."""
    ends = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.join(ends, key)
    spot = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    spot = F.greatest(F.least(spot, F.lit(bins - 1)), F.lit(0))
    return joined.groupBy(key, spot.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def histogram_quantiles(hist: DataFrame, key: str, bins: int, quantiles: list[float]) -> DataFrame:
    """(key, q, value): left edge of the first bin whose running count reaches ceil(q n)."""
    run = Window.partitionBy(key).orderBy("bin")
    counted = hist.withColumn("seen", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    asked = counted.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    reached = asked.filter(F.col("seen") >= F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1)))
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    return reached.groupBy(key, "q").agg(F.min_by(edge, "bin").alias("value"))
