"""Scans along a key that no single task makes: inside blocks of the order first, over the blocks' totals next.

``order`` is an integer and unique inside a key, unless a function says otherwise; blocks are equal ranges of it, so
dense numbers spread best. A task sees a block, or a row for each block of a key. Keys may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers of a block, and of a block of an affine scan (whose passes are its binary logarithm).
BLOCK, MAPS = 4096, 256


def _with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to one row for each (keys, _block); every block has one."""
    named = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_block").alias("_at"), *[c for c in totals.columns if c not in (*keys, "_block")])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)], rows["_block"] == named["_at"])
    return rows.join(named, same).drop("_at", *[f"_key{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, largest: bool = False, block: int | None = None) -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row, or with ``largest`` the greatest so far."""
    return runnings(df, keys, order, {name: (value, largest, True)}, block)


def runnings(df: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[Column, bool, bool]], block: int | None = None) -> DataFrame:
    """Several running values in one pass: name -> (value, whether the greatest or the sum, whether the row counts itself).

    A pass reads its rows twice, for the blocks' totals and for the rows, so what can go together should.
    """
    size = block or BLOCK
    rows = df.withColumns({f"_v{i}": v for i, (v, _, _) in enumerate(columns.values())}).withColumn("_block", F.floor(F.col(order) / size))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    f = [F.max if largest else F.sum for _, largest, _ in columns.values()]
    totals = rows.groupBy(*keys, "_block").agg(*[g(f"_v{i}").alias(f"_t{i}") for i, g in enumerate(f)])
    totals = totals.withColumns({f"_t{i}": g(f"_t{i}").over(earlier) for i, g in enumerate(f)})
    own = [0 if o else -1 for _, _, o in columns.values()]
    met = _with_totals(rows.withColumns({f"_i{i}": g(f"_v{i}").over(inside.rowsBetween(Window.unboundedPreceding, own[i])) for i, g in enumerate(f)}), totals, keys)
    for i, (name, (_, largest, _)) in enumerate(columns.items()):
        whole = F.greatest(f"_i{i}", f"_t{i}") if largest else F.coalesce(f"_t{i}", F.lit(0)) + F.col(f"_i{i}")
        met = met.withColumn(name, F.coalesce(whole, F.col(f"_t{i}")))
    return met.drop("_block", *[f"_{x}{i}" for x in "vti" for i in range(len(columns))])


def last_seen(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str, ahead: bool = False, own: bool = True) -> DataFrame:
    """``name``: the last value that is not null at or before each row, or with ``ahead`` the first at or after it;
    without ``own`` the row itself does not count.

    ``order`` may have ties and be of any kind; ``block`` must not fall as it rises.
    """
    rows = df.withColumn("_value", value).withColumn("_block", block)
    came = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = rows.groupBy(*keys, "_block").agg((F.min_by if ahead else F.max_by)("_value", came).alias("_end"))
    pick = F.first if ahead else F.last
    edge = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    span = ((0 if own else 1), Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, (0 if own else -1))
    ends = ends.withColumn("_end", pick("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(*edge)))
    inside = pick("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(*span))
    return _with_totals(rows.withColumn("_inside", inside), ends, keys).withColumn(name, F.coalesce("_inside", "_end")).drop("_value", "_block", "_inside", "_end")


def _affine(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """``_after`` for rows of (keys, _order, _a, _b, ...): the value of x = b + a x' at the next row."""
    rows = rows.withColumn("_block", F.floor(F.col("_order") / MAPS))
    window = Window.partitionBy(*keys, "_block").orderBy("_order")
    step = 1
    while step < MAPS:  # after the last pass a row holds the map from its block's end to itself
        ahead = rows.withColumn("_a2", F.lead("_a", step, 1.0).over(window)).withColumn("_b2", F.lead("_b", step, 0.0).over(window))
        rows = ahead.withColumn("_b", F.col("_b") + F.col("_a") * F.col("_b2")).withColumn("_a", F.col("_a") * F.col("_a2")).drop("_a2", "_b2")
        step *= 2
    next_a, next_b = F.lead("_a", 1, 1.0).over(window), F.lead("_b", 1, 0.0).over(window)
    if levels <= 1:
        return rows.withColumn("_after", next_b).drop("_block")
    heads = rows.groupBy(*keys, "_block").agg(F.min_by(F.struct("_a", "_b"), "_order").alias("_m"))
    heads = _affine(heads.select(*keys, F.col("_block").alias("_order"), F.col("_m._a").alias("_a"), F.col("_m._b").alias("_b")), keys, levels - 1)
    heads = heads.select(*keys, F.col("_order").alias("_block"), F.col("_after").alias("_carry"))
    met = _with_totals(rows.withColumn("_na", next_a).withColumn("_nb", next_b), heads, keys)
    return met.withColumn("_after", F.col("_nb") + F.col("_na") * F.col("_carry")).drop("_block", "_na", "_nb", "_carry")


def affine_after(df: DataFrame, keys: list[str], order: str, a: Column, b: Column, name: str) -> DataFrame:
    """``name``: x of the next row, where x = b + a x(next row) along ``order``; behind the last row x is 0.

    Affine maps compose to affine maps, so a block is one map: products inside blocks of ``MAPS`` places, then the same
    over the blocks, as many times as the order needs. ``order`` is 0 or more.
    """
    most = df.agg(F.max(order)).first()[0] or 0
    levels = 1
    while most >= MAPS**levels:
        levels += 1
    rows = df.withColumn("_order", F.col(order)).withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))
    return _affine(rows, keys, levels).withColumn(name, F.col("_after")).drop("_order", "_a", "_b", "_after")


def walk(df: DataFrame, key: str, rows: str, seed: str, least: int = 2, most: int = 4) -> DataFrame:
    """(key, place): rows of a sparse walk over the ``rows`` of a key, from 0 to the last one in steps of ``least`` to
    ``most`` (the last step may be shorter).

    Step i is a hash of (seed, key, i), so a walk is the same on any layout and engine; places are prefix sums of steps.
    A key without rows has no place. Keys are not null.
    """
    steps = F.ceil((F.col("_n") - 1) / least).cast("long")
    n = df.filter(F.col(rows) > 0).select(key, F.col(rows).cast("long").alias("_n"))
    blocks = n.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps / BLOCK))).alias("_block"))
    i = blocks.select(key, "_n", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(steps, (F.col("_block") + 1) * BLOCK - 1))).alias("_i"))
    text = F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("_i").cast("string"))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % (most - least + 1) + least
    step = F.when(F.col("_i") == 0, F.lit(0)).otherwise(drawn)
    gone = running(i.withColumn("_step", step), [key], "_i", F.col("_step"), "_sum")
    last = F.col("_n") - 1
    return gone.filter((F.col("_i") == 0) | (F.col("_sum") - F.col("_step") < last)).select(key, F.least("_sum", last).alias("place"))
