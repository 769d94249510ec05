"""Range, offset, as-of and nearest joins as plans that scale: equality on buckets first, the exact condition second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranks import sums_before
from strandline.operators.scans import last_seen


def range_join(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Points in [lo, hi). A range stands in every bucket of ``width`` that it touches, a point in one.

    Choose a width near the usual range length; longer ranges stand in more buckets.
    """
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    met = (F.col("_b") == F.col("_bucket")) & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    out = p.join(r, met, how)
    return out.drop("_b", "_bucket") if how not in ("left_semi", "left_anti") else out.drop("_b")


def offsets(df: DataFrame, order: str, length: str, block: int = 4096) -> DataFrame:
    """``start`` and ``stop`` of rows of the given lengths laid end to end in ``order`` (integers from 0 or more).

    Sums run inside blocks of the order first, then over the block totals, so that no task sees all rows.
    """
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = b.groupBy("_block").agg(F.sum(length).alias("_total"))
    bases = sums_before(totals, [], "_block", "_total", "_base").select("_block", "_base")
    out = b.withColumn("_sum", F.sum(length).over(inside)).join(bases, "_block")
    return out.withColumn("stop", F.col("_base") + F.col("_sum")).withColumn("start", F.col("stop") - F.col(length)).drop("_block", "_sum", "_base")


def _carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: float | None, ahead: bool = False) -> DataFrame:
    """``name``: the last ``value`` at or before each row, or the first at or after it. With ``width`` a task looks at that
    much of the first order column, else at a whole key."""
    if width is not None:
        return last_seen(df, keys, F.floor(F.col(order[0]) / width), order, F.col(value), name, ahead=ahead)
    w = Window.partitionBy(*keys).orderBy(*order)
    if ahead:
        return df.withColumn(name, F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_order: str, values: list[str], allow_equal: bool = True, width: float | None = None) -> DataFrame:
    """Left rows with the values of the last right row of the same key at or before their time (null if none).

    One pass: both sides in one partition order, the last right row carried forward. Of right rows with one time the
    one with the greatest ``right_order`` counts. Where a key may be hot, ``width`` cuts it into spans of time, over which
    the last right row is carried; times are numbers then.
    """
    first, second = (0, 1) if allow_equal else (1, 0)
    packed = F.struct(*values)
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(first).alias("_side"), F.col(right_order).cast("long").alias("_o"), packed.alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    m = left.select(*keys, F.col(left_time).alias("_t"), F.lit(second).alias("_side"), F.lit(None).cast("long").alias("_o"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"), F.struct("*").alias("_l"))
    carried = _carried(r.unionByName(m), keys, ["_t", "_side", "_o"], "_v", "_a", width).filter("_l is not null")
    return carried.select("_l.*", *[F.col("_a")[v].alias(v) for v in values])


def _around(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: list[Column], value: str, width: float | None) -> DataFrame:
    """Both sides with ``_a`` and ``_b``, the right rows (t, v) before and after each row."""
    kind = left.select(F.struct("*")).schema[0].dataType
    packed = F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))
    names = [f"_o{i}" for i in range(len(order))]
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[o.alias(n) for o, n in zip(order, names)], packed.alias("_v"), F.lit(None).cast(kind).alias("_l"))
    m = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(r.schema[n].dataType).alias(n) for n in names], F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"), F.struct("*").alias("_l"))
    both = _carried(r.unionByName(m), keys, ["_t", "_side", *names], "_v", "_a", width)
    return _carried(both, keys, ["_t", "_side", *names], "_v", "_b", width, ahead=True)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_order: str, value: str, width: float | None = None) -> DataFrame:
    """Left rows with the value of the right row of the same key nearest in time; of two equally near the earlier.

    ``width`` as in ``asof``.
    """
    both = _around(left, right, keys, left_time, right_time, [F.col(right_order).cast("long")], value, width)
    before = F.col("_t") - F.col("_a.t")
    after = F.col("_b.t") - F.col("_t")
    pick = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).when(before <= after, F.col("_a.v")).otherwise(F.col("_b.v"))
    return both.filter("_l is not null").select("_l.*", pick.alias(value))


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, width: float | None = None) -> DataFrame:
    """Left rows with the right value at their time by straight lines; beyond the ends the end value. ``width`` as in
    ``asof``."""
    both = _around(left, right, keys, left_time, right_time, [], value, width)
    gap = F.col("_b.t") - F.col("_a.t")
    between = F.when(gap > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_t") - F.col("_a.t")) / gap).otherwise(F.col("_a.v"))
    pick = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between)
    return both.filter("_l is not null").select("_l.*", pick.alias(value))


def unmatched(left: DataFrame, right: DataFrame, on: list[str], reason: str) -> DataFrame:
    """Violations: left rows without a partner."""
    return left.join(right, on, "left_anti").withColumn("reason", F.lit(reason))


def checked_lookup(left: DataFrame, right: DataFrame, on: Column, value: str, message: str) -> DataFrame:
    """Lookup that raises in the plan where a left row has no partner."""
    return left.join(right, on, "left").withColumn(value, F.coalesce(F.col(value), F.raise_error(F.lit(message)).cast("string")))
