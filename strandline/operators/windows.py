"""Sequence operators: an episode is a partition, its frames are in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.operators.scans import affine_after


def in_order(episode: str, *order: str) -> WindowSpec:
    return Window.partitionBy(episode).orderBy(*order)


def boundaries(df: DataFrame, episode: str, frame: str, step: int) -> DataFrame:
    """Frames 0, step, 2 step, ... and the last one."""
    last = F.max(frame).over(Window.partitionBy(episode))
    return df.withColumn("_last", last).filter((F.col(frame) % step == 0) | (F.col(frame) == F.col("_last"))).drop("_last")


def chain(df: DataFrame, episode: str, order: str, ident: str) -> DataFrame:
    """Units between consecutive boundaries: (episode, unit, before, after)."""
    w = in_order(episode, order)
    units = df.select(episode, (F.row_number().over(w) - 1).cast("long").alias("unit"), F.col(ident).alias("before"), F.lead(ident).over(w).alias("after"))
    return units.filter("after is not null")


def gather(df: DataFrame, w: WindowSpec, episode: str, frame: str, value: str, deltas: list[int]) -> DataFrame:
    """Values at frame + delta for each delta, clamped to the episode, with a mask of what was clamped."""
    whole = Window.partitionBy(episode)
    ends = df.withColumn("_first", F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "_last", F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    ends = ends.withColumn("_n", F.count("*").over(whole))
    at = [F.when(F.col(frame) + d < 0, F.col("_first")).when(F.col(frame) + d >= F.col("_n"), F.col("_last")).otherwise(F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w) if d < 0 else F.col(value)) for d in deltas]
    pad = [(F.col(frame) + d < 0) | (F.col(frame) + d >= F.col("_n")) for d in deltas]
    return ends.withColumn("gathered", F.array(*at)).withColumn("is_pad", F.array(*pad)).drop("_first", "_last", "_n")


def future_chunk(value: str, w: WindowSpec, n: int) -> Column:
    """The next ``n`` values from here, the episode's last one repeated."""
    seen = F.collect_list(value).over(w.rowsBetween(0, n - 1))
    return F.concat(seen, F.array_repeat(F.element_at(seen, -1), F.lit(n) - F.size(seen)))


def past_chunk(value: str, w: WindowSpec, n: int) -> tuple[Column, Column]:
    """The last ``n`` values up to here, the first repeated in front, and the mask of real ones."""
    seen = F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))
    short = F.lit(n) - F.size(seen)
    mask = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i >= short)
    return F.concat(F.array_repeat(F.element_at(seen, 1), short), seen), mask


def from_next_decided(decided: Column, raw: Column, w: WindowSpec) -> Column:
    """A null state takes the next decided one; after the last decided the episode's last raw value."""
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.first(decided, ignorenulls=True).over(ahead), F.last(raw).over(ahead))


def from_last_sign(signal: Column, w: WindowSpec, opened: float = 1.0) -> Column:
    """Forward fill of the last non-zero sign; before the first, its opposite; without any, ``opened``."""
    sign = F.when(signal != 0, F.signum(signal))
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(before, -first, F.lit(opened))


def step_change(value: str, w: WindowSpec, limit: float | None = None) -> Column:
    """Change from the frame before; the first frame keeps its value; wrapped once into [-limit, limit]."""
    d = F.col(value) - F.lag(value).over(w)
    if limit is not None:
        d = F.when(d > limit, d - 2 * limit).when(d < -limit, d + 2 * limit).otherwise(d)
    return F.coalesce(d, F.col(value))


def velocity(value: str, seconds: str, w: WindowSpec) -> Column:
    dt = F.col(seconds) - F.lag(seconds).over(w)
    return F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / dt).otherwise(0.0)


def next_or_self(value: str, w: WindowSpec) -> Column:
    return F.coalesce(F.lead(value).over(w), F.col(value))


def spread_indices(n: Column, points: int) -> Column:
    """Distinct half-even rounded positions of ``points`` evenly spaced from 0 to n - 1."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.bround(k * (n - 1) / (points - 1), 0).cast("long")))


def sample_count(n: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    return F.greatest(F.least(F.lit(least), n), F.least(F.floor(F.pow(n, F.lit(power))), F.lit(most)))


def time_grid(df: DataFrame, key: str, seconds: str, value: str, order: str, dt: float) -> DataFrame:
    """(key, slot, value): the first sample of each time slot since the key's first sample; gaps repeat the slot before."""
    first = F.min(seconds).over(Window.partitionBy(key))
    slots = df.withColumn("slot", F.floor((F.col(seconds) - first) / dt + 1e-5)).groupBy(key, "slot").agg(F.min_by(value, F.struct(seconds, order)).alias("value"))
    nxt = F.coalesce(F.lead("slot").over(Window.partitionBy(key).orderBy("slot")), F.col("slot") + 1)
    return slots.withColumn("until", nxt).select(key, F.explode(F.sequence(F.col("slot"), F.col("until") - 1)).alias("slot"), "value")


def discounted(df: DataFrame, episode: str, order: str, reward: Column, done: Column, value: Column, gamma: float, lam: float) -> DataFrame:
    """(episode, order, advantage): generalised advantage estimates, cut where ``done``.

    With w = value + lam advantage the recurrence is one affine map a frame, w = lam reward + (1 - lam) value
    + lam gamma (1 - done) w(next), so it is an associative scan; ``order`` is an integer from 0, unique in an episode.
    """
    rows = df.select(episode, order, reward.cast("double").alias("_r"), done.cast("double").alias("_d"), value.cast("double").alias("_v"))
    keep = gamma * (1 - F.col("_d"))
    rows = affine_after(rows, [episode], order, lam * keep, lam * F.col("_r") + (1 - lam) * F.col("_v"), "_w")
    return rows.select(episode, order, (F.col("_r") - F.col("_v") + keep * F.col("_w")).alias("advantage"))
