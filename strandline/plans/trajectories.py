"""Events as waypoints of their user's trajectory: arrival times under speed limits, poses on a grid, trimmed parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import poses as P
from strandline.plans.common import FRAMES, frames, fresh_folder
from strandline.plans.extras import quat

c = F.col
#: Speed and turning speed an hour, and the hours that a task looks at.
SPEED, TURN, WIDTH = 9.0, 0.4, 1000.0


def waypoints(spark, root):
    """(episode, frame, event_id, asked, pose): hours since the episode's first event, positions and rotations by value."""
    f = frames(spark, root).withColumn("t", F.unix_micros(c("ts").cast("timestamp")))
    first = f.groupBy(c("episode").alias("e")).agg(F.min("t").alias("t0"))
    f = f.join(first, c("episode") == c("e")).withColumn("asked", (c("t") - c("t0")) / 3.6e9)
    place = F.array(c("value"), c("value") / 2, (c("frame") % 5).cast("double"))
    turned = V.euler_to_quaternion(c("value") / 20, (c("frame") % 7) / 7, (c("frame") % 3) / 2)
    return f.select("episode", "frame", "event_id", "asked", P.pose(place, turned).alias("pose"))


def track(spark, root):
    """Waypoints with their arrival, written once for all who read them."""
    at = fresh_folder(spark, "track")
    P.arrivals(waypoints(spark, root), ["episode"], "frame", "asked", SPEED, TURN).write.parquet(at)
    return spark.read.parquet(at)


def shown(df, *columns):
    at = lambda part, i: F.round(F.get(c(f"pose.{part}"), F.lit(i)), 4) + 0.0  # noqa: E731 - no negative zeros
    return df.select(*columns, *[at("position", i).alias(n) for i, n in enumerate("xyz")], *[at("rotation", i).alias(f"q{i}") for i in range(4)])


def arrived(spark, root):
    return track(spark, root).select("event_id", F.round("arrival", 5).alias("arrival"))


def on_grid(spark, root):
    """Poses every 50 hours."""
    t = track(spark, root)
    last = t.groupBy("episode").agg(F.max("arrival").alias("last"))
    asked = last.select("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("last") / 50))).alias("k")).withColumn("at", c("k") * 50.0)
    return shown(P.pose_at(asked, t, ["episode"], "at", "arrival", WIDTH), "episode", "k")


def middle(spark, root):
    """The part from 100 to 400 hours: where it begins, where it ends and the waypoints between, in order."""
    t = track(spark, root)
    spans = t.select("episode").distinct().select("episode", F.lit(100.0).alias("lo"), F.lit(400.0).alias("hi"))
    return shown(P.trim(t, spans, ["episode"], "arrival", "lo", "hi", WIDTH).withColumn("arrival", F.round("arrival", 5)), "episode", "arrival")


ANGLE = "2 * acos(least(abs(p0*q0 + p1*q1 + p2*q2 + p3*q3), 1.0))"
#: CTE ``w``: waypoints with their arrival, one after another.
TRACK = f"""{FRAMES}, h AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY episode)) / 3.6e9 AS asked, (value / 20) AS roll, (frame % 7) / 7.0::DOUBLE AS pitch, (frame % 3) / 2.0::DOUBLE AS yaw FROM f),
  p AS (SELECT episode, frame, event_id, asked, value AS x, value / 2 AS y, CAST(frame % 5 AS DOUBLE) AS z, {quat("q", "roll", "pitch", "yaw")} FROM h),
  l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz, {", ".join(f"lag(q{i}) OVER o AS p{i}" for i in range(4))} FROM p WINDOW o AS (PARTITION BY episode ORDER BY frame)),
  d AS (SELECT *, greatest(sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) / {SPEED}, {ANGLE} / {TURN}) AS least FROM l),
  w AS (SELECT episode, frame, asked AS arrival FROM d WHERE frame = 0
        UNION ALL SELECT d.episode, d.frame, greatest(d.asked, w.arrival + d.least) FROM w JOIN d ON d.episode = w.episode AND d.frame = w.frame + 1),
  t AS (SELECT d.*, arrival FROM d JOIN w USING (episode, frame))"""
#: The poses of ``asked`` (episode, k, t) between the waypoints around them.
POSED = f"""a AS (SELECT asked.episode, k, asked.t, max(arrival) AS ta FROM asked JOIN t ON t.episode = asked.episode AND arrival <= asked.t GROUP BY ALL),
  b AS (SELECT a.*, min(arrival) AS tb FROM a LEFT JOIN t ON t.episode = a.episode AND arrival >= a.t GROUP BY ALL),
  m AS (SELECT b.*, {", ".join(f"u.{n} AS a_{n}, v.{n} AS b_{n}" for n in ("x", "y", "z", "q0", "q1", "q2", "q3"))}, CASE WHEN tb > ta THEN (b.t - ta) / (tb - ta) ELSE 0 END AS s
        FROM b JOIN t u ON u.episode = b.episode AND u.arrival = ta JOIN t v ON v.episode = b.episode AND v.arrival = coalesce(tb, ta)),
  g AS (SELECT *, a_q0*b_q0 + a_q1*b_q1 + a_q2*b_q2 + a_q3*b_q3 AS raw FROM m), n AS (SELECT *, acos(least(abs(raw), 1.0)) AS angle, CASE WHEN raw < 0 THEN -1 ELSE 1 END AS sign FROM g),
  k AS (SELECT *, CASE WHEN abs(raw) > 0.9995 THEN 1 - s ELSE sin((1 - s) * angle) / sin(angle) END AS wa, CASE WHEN abs(raw) > 0.9995 THEN s ELSE sin(s * angle) / sin(angle) END * sign AS wb FROM n),
  r AS (SELECT *, {", ".join(f"a_q{i}*wa + b_q{i}*wb AS m{i}" for i in range(4))} FROM k)"""
SHOWN = ", ".join(f"round(a_{n} + (b_{n} - a_{n}) * s, 4) + 0.0 AS {n}" for n in "xyz") + ", " + ", ".join(f"round(m{i} / sqrt(m0*m0 + m1*m1 + m2*m2 + m3*m3), 4) + 0.0 AS q{i}" for i in range(4))
QUERIES = [
    ("w18_arrivals", arrived, f"WITH RECURSIVE {TRACK} SELECT event_id, round(arrival, 5) AS arrival FROM t"),
    ("w18_on_grid", on_grid, f"WITH RECURSIVE {TRACK}, e AS (SELECT episode, max(arrival) AS last FROM t GROUP BY 1), asked AS (SELECT episode, k, k * 50.0::DOUBLE AS t FROM (SELECT episode, unnest(range(0, CAST(floor(last / 50) AS BIGINT) + 1)) AS k FROM e)), {POSED} SELECT episode, k, {SHOWN} FROM r"),
    ("w18_trimmed", middle, f"WITH RECURSIVE {TRACK}, asked AS (SELECT DISTINCT episode, 0 AS k, unnest([100.0::DOUBLE, 400.0::DOUBLE]) AS t FROM t UNION ALL SELECT episode, 0, arrival FROM t WHERE arrival > 100 AND arrival < 400), {POSED} SELECT episode, round(t, 5) AS arrival, {SHOWN} FROM r"),
]
