"""Trajectories of poses: waypoints with a time, a position and a rotation, interpolated, trimmed and scheduled.

A pose is a struct ``pose`` of ``position`` array<double> and ``rotation``, a unit quaternion (w, x, y, z). Positions
move along lines, rotations along the shorter arc; before its first and after its last waypoint a trajectory rests.
Keys may be null. Work inside a key is done in blocks of the order or of time, see ``scans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import scans


def pose(position: Column, rotation: Column) -> Column:
    return F.struct(position.alias("position"), rotation.alias("rotation"))


def least_duration(a: Column, b: Column, most_speed: float, most_turn: float) -> Column:
    """The time that it takes at least from pose to pose, by speed and by turning speed (radians)."""
    way = V.norm(V.minus(b["position"], a["position"])) / most_speed
    turn = 2 * F.acos(F.least(F.abs(V.dot(a["rotation"], b["rotation"])), F.lit(1.0))) / most_turn
    return F.greatest(way, turn)


def between(a: Column, b: Column, share: Column) -> Column:
    """The pose at a share of the way; either may be null, then it is the other."""
    moved = F.zip_with(a["position"], b["position"], lambda x, y: x + (y - x) * share)
    mixed = pose(moved, V.slerp(a["rotation"], b["rotation"], share))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(mixed)


def arrivals(asked: DataFrame, keys: list[str], order: str, time: str, most_speed: float, most_turn: float) -> DataFrame:
    """Waypoints (keys, order, time, pose) with ``arrival``: the time asked for, or as soon as the speed limits let the
    pose before be left and this one be reached.

    t = max(asked, t before + least duration) is max-plus linear: with D the running sum of least durations,
    t = D + the running maximum of asked - D.
    """
    before = scans.last_seen(asked, keys, F.floor(F.col(order) / scans.BLOCK), [order], F.col("pose"), "_from", own=False)
    least = F.coalesce(least_duration(F.col("_from"), F.col("pose"), most_speed, most_turn), F.lit(0.0))
    gone = scans.running(before.withColumn("_least", least), keys, order, F.col("_least"), "_gone")
    ahead = scans.running(gone, keys, order, F.col(time) - F.col("_gone"), "_ahead", largest=True)
    return ahead.withColumn("arrival", F.col("_gone") + F.col("_ahead")).drop("_from", "_least", "_gone", "_ahead")


def pose_at(asked: DataFrame, waypoints: DataFrame, keys: list[str], at: str, time: str, width: float) -> DataFrame:
    """Rows of ``asked`` with the ``pose`` of their key's trajectory at ``at``; null for a key without waypoints.

    ``width`` is the time that one task looks at. Of waypoints at one time any may count.
    """
    row = F.struct(*[F.col(c) for c in asked.columns])
    none = F.lit(None)
    point = F.struct(F.col(time).cast("double").alias("t"), F.col("pose").alias("p"))
    kind = waypoints.select(point.alias("x")).schema[0].dataType
    left = asked.select(*keys, F.col(at).cast("double").alias("_t"), row.alias("_row"), none.cast(kind).alias("_p"))
    right = waypoints.select(*keys, F.col(time).cast("double").alias("_t"), none.cast(asked.select(row.alias("x")).schema[0].dataType).alias("_row"), point.alias("_p"))
    # of rows at one time the waypoints come first, so that an asked one sees them behind itself
    both, block = left.unionByName(right).withColumn("_side", F.col("_row").isNotNull().cast("int")), F.floor(F.col("_t") / width)
    both = scans.last_seen(both, keys, block, ["_t", "_side"], F.col("_p"), "_a")
    both = scans.last_seen(both, keys, block, ["_t", "_side"], F.col("_p"), "_b", ahead=True)
    gap = F.col("_b.t") - F.col("_a.t")
    share = F.when(gap > 0, (F.col("_t") - F.col("_a.t")) / gap).otherwise(0.0)
    return both.filter("_row is not null").select("_row.*", between(F.col("_a.p"), F.col("_b.p"), share).alias("pose"))


def trim(waypoints: DataFrame, spans: DataFrame, keys: list[str], time: str, lo: str, hi: str, width: float) -> DataFrame:
    """(keys, time, pose): the part of each key's trajectory in its span: the waypoints inside, and the poses at both ends
    (one, if they are one). A key has one span; a key without one has no rows."""
    s = spans.select(*keys, F.col(lo).cast("double").alias("_lo"), F.col(hi).cast("double").alias("_hi"))
    ends = s.select(*keys, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(time))
    ends = pose_at(ends, waypoints, keys, time, time, width)
    return _inside(waypoints, s, keys, time).unionByName(ends)


def _inside(waypoints: DataFrame, spans: DataFrame, keys: list[str], time: str) -> DataFrame:
    named = spans.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_lo", "_hi")
    same = (F.col(time) > F.col("_lo")) & (F.col(time) < F.col("_hi"))
    for i, k in enumerate(keys):
        same &= waypoints[k].eqNullSafe(named[f"_key{i}"])
    return waypoints.join(named, same).select(*keys, F.col(time).cast("double").alias(time), "pose")


def drive_to(waypoints: DataFrame, commands: DataFrame, keys: list[str], time: str, most_speed: float, most_turn: float, width: float) -> DataFrame:
    """(keys, time, pose): where each key is at its command's ``now``, and the command's ``target`` at its ``when`` or as
    soon after ``now`` as the limits allow. Commands: (keys, now, when, target), one for each key."""
    here = pose_at(commands.withColumn("now", F.col("now").cast("double")), waypoints, keys, "now", time, width)
    least = least_duration(F.col("pose"), F.col("target"), most_speed, most_turn)
    last = F.col("now") + F.greatest(F.greatest(F.col("when").cast("double"), F.col("now")) - F.col("now"), least)
    both = F.array(F.struct(F.col("now").alias("t"), F.col("pose").alias("p")), F.struct(last.alias("t"), F.col("target").alias("p")))
    return here.filter("pose is not null").select(*keys, F.explode(both).alias("_x")).select(*keys, F.col("_x.t").alias(time), F.col("_x.p").alias("pose"))


def schedule(waypoints: DataFrame, commands: DataFrame, keys: list[str], time: str, most_speed: float, most_turn: float, width: float) -> DataFrame:
    """(keys, time, pose): each key's trajectory with its command's ``target`` put at its end.

    Commands: (keys, when, target, now, last), one for each key; ``now`` and ``last`` may be null, ``last`` needs ``now``.
    What lies before ``now`` goes, what lies behind the end goes: that is the trajectory's end without ``now``, else
    ``last`` if the new time is later, or ``now``; never later than the new time. From there the target is reached at
    ``when`` or as soon as the limits allow. A new time that is not after ``now`` changes nothing, and neither does a key
    without a command.
    """
    spans = waypoints.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min(time).cast("double").alias("_first"), F.max(time).cast("double").alias("_final"))
    c = commands.withColumns({n: F.col(n).cast("double") for n in ("when", "now", "last")})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= c[k].eqNullSafe(spans[f"_key{i}"])
    c = c.join(spans, same).drop(*[f"_key{i}" for i in range(len(keys))]).filter("now is null or when > now")
    end = F.when(F.col("now").isNull(), F.col("_final")).when(F.col("last").isNull() | (F.col("when") <= F.col("last")), F.col("now")).otherwise(F.greatest("last", "now"))
    c = c.withColumn("_hi", F.least(end, F.col("when")))
    c = c.withColumn("_lo", F.least(F.greatest(F.coalesce("now", "_first"), F.col("_first")), F.col("_hi")))
    kept = trim(waypoints, c, keys, time, "_lo", "_hi", width)
    ends = pose_at(c, waypoints, keys, "_hi", time, width)
    least = least_duration(F.col("pose"), F.col("target"), most_speed, most_turn)
    added = ends.select(*keys, (F.col("_hi") + F.greatest(F.col("when") - F.col("_hi"), least)).alias(time), F.col("target").alias("pose"))
    named = c.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    met = F.lit(True)
    for i, k in enumerate(keys):
        met &= waypoints[k].eqNullSafe(named[f"_key{i}"])
    rest = waypoints.join(named, met, "left_anti").select(*keys, F.col(time).cast("double").alias(time), "pose")
    return kept.unionByName(added).unionByName(rest)
