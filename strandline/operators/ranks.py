"""Row numbers that no single task computes: ranks inside blocks of the order, plus the counts of the blocks before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers of one block of an integer order, and blocks whose totals meet in one task.
BLOCK = 4096


def sums_before(blocks: DataFrame, keys: list[str], block: str, value: str, name: str, total: str | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over the key's earlier blocks; ``total``: over all of them.

    ``blocks`` has one row for each key and integer block. Blocks add up inside groups of ``BLOCK`` first and groups
    afterwards, so a task sees a group of blocks, or the totals of the groups (a row for each ``BLOCK`` squared integers).
    """
    b = blocks.withColumn("_group", F.floor(F.col(block) / BLOCK))
    inside = Window.partitionBy(*keys, "_group").orderBy(block)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    groups = b.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum"))
    bases = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_group").alias("_g"), (F.sum("_sum").over(whole.orderBy("_group")) - F.col("_sum")).alias("_up"), F.sum("_sum").over(whole).alias("_all"))
    same = reduce(lambda a, x: a & x, [b[k].eqNullSafe(bases[f"_k{i}"]) for i, k in enumerate(keys)], b["_group"].eqNullSafe(bases["_g"]))
    out = b.withColumn("_in", F.sum(value).over(inside) - F.col(value)).join(bases, same).withColumn(name, F.col("_up") + F.col("_in"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_group", "_g", "_up", "_in", "_all", *[f"_k{i}" for i in range(len(keys))])


def blocked_rank(df: DataFrame, keys: list[str], block: Column, order: list[Column | str], name: str = "rank", total: str = "total") -> DataFrame:
    """``name`` from 0 in order of (block, order) inside each key, and ``total``, the key's rows.

    ``block`` must not fall as the order rises. A hot key is spread over its blocks; block counts meet in two levels.
    """
    b = df.withColumn("_block", block)
    counts = b.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    bases = sums_before(counts, keys, "_block", "_n", "_base", total)
    bases = bases.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_base", total)
    same = reduce(lambda a, x: a & x, [b[k].eqNullSafe(bases[f"_key{i}"]) for i, k in enumerate(keys)], b["_block"].eqNullSafe(bases["_b"]))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    ranked = b.withColumn("_in", inside).join(bases, same)
    return ranked.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_block", "_in", "_base", "_b", *[f"_key{i}" for i in range(len(keys))])


def position(df: DataFrame, order: str, keys: list[str] | None = None, tie: list[str] | None = None, name: str = "rank", total: str = "total") -> DataFrame:
    """Rank by an integer column (dense ids spread best) inside each key or over all rows."""
    return blocked_rank(df, keys or [], F.floor(F.col(order) / BLOCK), [order, *(tie or [])], name, total)
