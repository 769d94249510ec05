"""Window and sequence queries over event frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import scans
from strandline.operators import windows as W
from strandline.plans.common import FRAMES, frames
from strandline.sources.tables import table

c = F.col


def w():
    """An episode's frames in order."""
    return W.in_order("episode", "frame")


def seconds(df):
    return df.withColumn("t", F.unix_micros(c("ts").cast("timestamp")) / 1e6)


def listed(x):
    return F.array_join(F.transform(x, lambda v: F.format_string("%.2f", v)), ",")


def sampled(spark, root):
    return W.boundaries(frames(spark, root), "episode", "frame", 25).select("episode", "frame", "event_id")


def chained(spark, root):
    b = W.boundaries(frames(spark, root), "episode", "frame", 10)
    return W.chain(b, "episode", "frame", "event_id")


def gathered(spark, root):
    g = W.gather(frames(spark, root), w(), "episode", "frame", "value", [-2, -1, 0, 3])
    return g.select("event_id", listed("gathered").alias("values"), F.array_join(F.transform("is_pad", lambda p: p.cast("int").cast("string")), "").alias("pad"))


def chunked(spark, root):
    return frames(spark, root).select("event_id", listed(W.future_chunk("value", w(), 5)).alias("chunk"))


def history(spark, root):
    """Past 4 with mask and future 3; the episode ends 3 frames early."""
    past, mask = W.past_chunk("value", w(), 4)
    rows = frames(spark, root).select("event_id", "frame", F.count("*").over(Window.partitionBy("episode")).alias("n"), past.alias("p"), mask.alias("m"), F.collect_list("value").over(w().rowsBetween(0, 3)).alias("f"))
    rows = rows.filter(c("frame") < c("n") - 3)
    return rows.select("event_id", listed("p").alias("past"), F.array_join(F.transform("m", lambda x: x.cast("int").cast("string")), "").alias("mask"), listed("f").alias("future"))


def padded_starts(spark, root):
    """Every window of 8 from 2 before to 3 past the end; edge frames repeat."""
    per = frames(spark, root).groupBy("episode").agg(F.count("*").alias("n"))
    starts = per.select("episode", "n", F.explode(F.sequence(F.lit(-2).cast("long"), c("n") - 8 + 3)).alias("start"))
    return starts.select("episode", "start", F.greatest(c("start"), F.lit(0)).alias("lo"), F.least(c("start") + 8, c("n")).alias("hi"), F.greatest(-c("start"), F.lit(0)).alias("pad_before"), F.greatest(c("start") + 8 - c("n"), F.lit(0)).alias("pad_after"))


def changes(spark, root):
    return frames(spark, root).select("event_id", F.round(W.step_change("value", w(), 50.0), 6).alias("change"), F.round(W.next_or_self("value", w()), 6).alias("action"))


def differences(spark, root):
    d = frames(spark, root).select("event_id", (F.lead("value").over(w()) - c("value")).alias("d"))
    return d.filter("d is not null").select("event_id", F.round("d", 6).alias("d"))


def gripper(spark, root):
    decided = F.when(c("value") > 40, 1.0).when(c("value") < 5, 0.0)
    return frames(spark, root).select("event_id", F.round(W.from_next_decided(decided, c("value"), w()), 6).alias("state"), F.round(W.from_last_sign(F.when(c("value") > 60, 1.0).when(c("value") < 2, -1.0).otherwise(0.0), w()), 1).alias("absolute"))


def velocities(spark, root):
    return seconds(frames(spark, root)).select("event_id", F.round(W.velocity("value", "t", w()), 6).alias("velocity"))


def keyframes(spark, root):
    per = frames(spark, root).groupBy("episode").agg(F.count("*").alias("n"))
    return per.select("episode", F.explode(W.spread_indices(c("n"), 6)).alias("frame"), W.sample_count(c("n"), 20, 40).cast("long").alias("samples"))


def keyframe_values(spark, root):
    return keyframes(spark, root).select("episode", "frame").join(frames(spark, root), ["episode", "frame"]).select("episode", "frame", "event_id")


def gridded(spark, root):
    g = W.time_grid(seconds(frames(spark, root)), "episode", "t", "value", "event_id", 43200.0)
    return g.select("episode", "slot", "value")


def moved_first(spark, root):
    """First frame whose value differs from the first by more than 10; else the last frame."""
    f = frames(spark, root).withColumn("v0", F.first("value").over(w()))
    return f.groupBy("episode").agg(F.coalesce(F.min(F.when(F.abs(c("value") - c("v0")) > 10, c("frame"))), F.max("frame")).alias("frame"))


def latest_run(spark, root):
    from strandline.operators.reports import latest

    return latest(table(spark, root, "events"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


def moving(spark, root):
    m = w().rowsBetween(-9, 0)
    return frames(spark, root).select("event_id", F.round(F.avg("value").over(m), 6).alias("mean"), F.max("value").over(m).alias("most"))


def gae(spark, root):
    f = frames(spark, root)
    adv = W.discounted(f, "episode", "frame", c("value") / 100, c("event_type") == "signup", c("value") / 200, 0.9, 0.8)
    return adv.select("episode", "frame", F.round("advantage", 6).alias("advantage"))


def prefix_ends(spark, root):
    """Sparse prefix ends of each episode: the first and the last frame, and steps of two to four between them."""
    n = table(spark, root, "events").groupBy(c("user_id").alias("episode")).agg(F.count("*").alias("n"))
    return scans.walk(n, "episode", "n", "prefix").select("episode", c("place").alias("frame"))


def goals(spark, root):
    """A later frame of the episode, chosen by a hash of the frame's id; the last frame has none."""
    f = frames(spark, root).withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    pick = F.conv(F.substring(F.md5(c("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    f = f.filter(c("frame") < c("n") - 1).withColumn("goal", c("frame") + 1 + pick % (c("n") - c("frame") - 1))
    g = frames(spark, root).select("episode", c("frame").alias("goal"), c("event_id").alias("goal_event"))
    return f.select("episode", "event_id", "goal").join(g, ["episode", "goal"]).select("event_id", "goal", "goal_event")


def slots(spark, root):
    """Dense slot of each event type by its first appearance in the episode."""
    first = frames(spark, root).groupBy("episode", "event_type").agg(F.min("frame").alias("first"))
    s = F.dense_rank().over(Window.partitionBy("episode").orderBy("first")) - 1
    return first.select("episode", "event_type", s.cast("long").alias("slot"))


def memory_map(spark, root):
    """Boundary and unit tokens in the order B0 U0 B1 U1 ...: two for a boundary, three for a unit."""
    turns = table(spark, root, "conversations").select("conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    parts = F.when(c("turn") < c("n") - 1, F.array(F.struct(F.lit("B").alias("kind"), F.lit(2).alias("k")), F.struct(F.lit("U").alias("kind"), F.lit(3).alias("k")))).otherwise(F.array(F.struct(F.lit("B").alias("kind"), F.lit(2).alias("k"))))
    tokens = turns.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", "p.kind", F.explode(F.sequence(F.lit(0), c("p.k") - 1)).alias("i"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "kind", "i")) - 1
    return tokens.select("conv_id", "turn", "kind", c("i").cast("long").alias("token"), at.cast("long").alias("place"))


def idle(spark, root):
    """Frames that are no no-ops: a small step and the same type as before is one; a first frame is one by its size."""
    small = F.abs(c("value") - F.coalesce(F.lag("value").over(w()), F.lit(0.0))) < 8
    same = F.coalesce(F.lag("event_type").over(w()) == c("event_type"), F.lit(True))
    f = frames(spark, root).withColumn("noop", small & same)
    return f.filter("not noop").select("event_id")


def shrunk(spark, root):
    """Frames without the first 3 and last 2; short episodes vanish."""
    f = frames(spark, root).withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    return f.filter((c("frame") >= 3) & (c("frame") < c("n") - 2)).select("event_id", (c("frame") - 3).alias("frame"))


def repeat_to_minimum(spark, root):
    """Samples n - 8 + 1 of each episode, repeated in whole and by a prefix up to 90."""
    per = frames(spark, root).groupBy("episode").agg((F.count("*") - 7).alias("m")).filter("m > 0")
    return per.select("episode", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(c("m"), F.lit(90)) - 1)).alias("k", "i"), "m").select("episode", c("i").alias("k"), (c("i") % c("m")).alias("sample"))


def validity(spark, root):
    per = frames(spark, root).groupBy("episode").agg(F.count("*").alias("n"), F.max_by("event_type", "frame").alias("end"))
    steps = F.when(c("end") == "error", c("n")).otherwise(F.least(c("n"), F.lit(40)))
    return per.select("episode", F.transform(F.sequence(F.lit(1).cast("long"), c("n")), lambda i: (i <= steps).cast("int")).alias("m")).select("episode", F.array_join(F.transform("m", lambda x: x.cast("string")), "").alias("mask"))


def stride(spark, root):
    """Frames at stride 4 so that (kept - 1) strides fit; the tail goes."""
    f = frames(spark, root).withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    return f.filter((c("frame") % 4 == 0) & (c("frame") <= c("n") - 1 - (c("n") - 1) % 4)).select("episode", "frame")


def relative_chunk(spark, root):
    """Row 0 is the state, rows 1..4 are changes against it."""
    chunk = W.future_chunk("value", w(), 5)
    return frames(spark, root).select("event_id", listed(F.transform(chunk, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(chunk, F.lit(0))))).alias("chunk"))


def episodic(spark, root):
    e = frames(spark, root).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("s"))
    return e.select("episode", F.size("s").cast("long").alias("n"), listed(c("s.value")).alias("samples"))


def pad_to(spark, root):
    """Events of type error padded to 100 rows a user with copies of the first, marked invalid."""
    f = frames(spark, root)
    per = f.groupBy("episode").agg(F.count("*").alias("n"), F.min_by("event_id", "frame").alias("event_id"))
    pads = per.filter("n < 100").select("episode", F.explode(F.sequence(c("n"), F.lit(99).cast("long"))).alias("frame"), "event_id", F.lit(False).alias("valid"))
    return f.select("episode", "frame", "event_id", F.lit(True).alias("valid")).unionByName(pads)


FMT = "string_agg(printf('%.2f', {0}), ',' ORDER BY {1})"
QUERIES = [
    ("w01_boundaries", sampled, f"WITH {FRAMES} SELECT episode, frame, event_id FROM (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f) WHERE frame % 25 = 0 OR frame = last"),
    ("w02_chain", chained, f"WITH {FRAMES}, b AS (SELECT * FROM (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f) WHERE frame % 10 = 0 OR frame = last), u AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY frame) - 1 AS unit, event_id AS before, lead(event_id) OVER (PARTITION BY episode ORDER BY frame) AS after FROM b) SELECT * FROM u WHERE after IS NOT NULL"),
    ("w03_gather", gathered, f"WITH {FRAMES}, n AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f), d AS (SELECT unnest([-2, -1, 0, 3]) AS d) SELECT a.event_id, {FMT.format('b.value', 'd')} AS \"values\", string_agg(CASE WHEN a.frame + d < 0 OR a.frame + d > a.last THEN '1' ELSE '0' END, '' ORDER BY d) AS pad FROM n a, d JOIN f b ON true WHERE b.episode = a.episode AND b.frame = greatest(least(a.frame + d, a.last), 0) GROUP BY 1"),
    ("w04_v03_chunk", chunked, f"WITH {FRAMES}, n AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f), d AS (SELECT unnest(range(5)) AS d) SELECT a.event_id, {FMT.format('b.value', 'd')} AS chunk FROM n a, d JOIN f b ON true WHERE b.episode = a.episode AND b.frame = least(a.frame + d, a.last) GROUP BY 1"),
    ("w05_history", history, f"WITH {FRAMES}, n AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f), d AS (SELECT unnest(range(-3, 4)) AS d) SELECT a.event_id, string_agg(printf('%.2f', b.value), ',' ORDER BY d) FILTER (d <= 0) AS past, string_agg(CASE WHEN a.frame + d >= 0 THEN '1' ELSE '0' END, '' ORDER BY d) FILTER (d <= 0) AS mask, string_agg(printf('%.2f', b.value), ',' ORDER BY d) FILTER (d >= 0) AS future FROM n a, d JOIN f b ON true WHERE b.episode = a.episode AND a.frame < a.last - 2 AND b.frame = greatest(a.frame + d, 0) GROUP BY 1"),
    ("w06_b09_padded_starts", padded_starts, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n FROM f GROUP BY 1), s AS (SELECT episode, n, unnest(range(-2, n - 8 + 4)) AS start FROM p) SELECT episode, start, greatest(start, 0) AS lo, least(start + 8, n) AS hi, greatest(-start, 0) AS pad_before, greatest(start + 8 - n, 0) AS pad_after FROM s"),
    ("w08_w13_changes", changes, f"WITH {FRAMES}, d AS (SELECT *, value - lag(value) OVER w AS d, coalesce(lead(value) OVER w, value) AS action FROM f WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT event_id, round(coalesce(CASE WHEN d > 50 THEN d - 100 WHEN d < -50 THEN d + 100 ELSE d END, value), 6) AS change, round(action, 6) AS action FROM d"),
    ("w09_differences", differences, f"WITH {FRAMES}, d AS (SELECT event_id, lead(value) OVER (PARTITION BY episode ORDER BY frame) - value AS d FROM f) SELECT event_id, round(d, 6) AS d FROM d WHERE d IS NOT NULL"),
    ("w10_w11_gripper", gripper, f"WITH {FRAMES}, s AS (SELECT *, CASE WHEN value > 40 THEN 1.0 WHEN value < 5 THEN 0.0 END::DOUBLE AS g, CASE WHEN value > 60 THEN 1 WHEN value < 2 THEN -1 END AS sign FROM f) SELECT event_id, round(coalesce(first_value(g IGNORE NULLS) OVER a, last_value(value) OVER a), 6) AS state, coalesce(last_value(sign IGNORE NULLS) OVER b, -first_value(sign IGNORE NULLS) OVER a0, 1)::DOUBLE AS absolute FROM s WINDOW a AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a0 AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("w12_velocity", velocities, f"WITH {FRAMES}, d AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM f) SELECT event_id, round(coalesce(CASE WHEN t > lag(t) OVER w THEN (value - lag(value) OVER w) / (t - lag(t) OVER w) END, 0), 6) AS velocity FROM d WINDOW w AS (PARTITION BY episode ORDER BY frame)"),
    ("w14_w15_keyframes", keyframes, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n FROM f GROUP BY 1) SELECT DISTINCT episode, CAST(round_even(unnest(range(6)) * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) AS frame, CAST(greatest(least(20, n), least(floor(pow(n, 0.75)), 40)) AS BIGINT) AS samples FROM p"),
    ("w27_keyframe_values", keyframe_values, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n FROM f GROUP BY 1), k AS (SELECT DISTINCT episode, CAST(round_even(unnest(range(6)) * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) AS frame FROM p) SELECT episode, frame, event_id FROM k JOIN f USING (episode, frame)"),
    ("w16_w17_grid", gridded, f"WITH {FRAMES}, t AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM f), s AS (SELECT episode, CAST(floor((t - min(t) OVER (PARTITION BY episode)) / 43200.0 + 1e-5) AS BIGINT) AS slot, value, frame FROM t), b AS (SELECT episode, slot, arg_min(value, frame) AS value FROM s GROUP BY 1, 2), u AS (SELECT *, coalesce(lead(slot) OVER (PARTITION BY episode ORDER BY slot), slot + 1) AS until FROM b) SELECT episode, unnest(range(slot, until)) AS slot, value FROM u"),
    ("w20_f15_first_move", moved_first, f"WITH {FRAMES}, v AS (SELECT *, first_value(value) OVER (PARTITION BY episode ORDER BY frame) AS v0 FROM f) SELECT episode, coalesce(min(frame) FILTER (abs(value - v0) > 10), max(frame)) AS frame FROM v GROUP BY 1"),
    ("w21_o06_latest", latest_run, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"),
    ("w22_moving", moving, f"WITH {FRAMES} SELECT event_id, round(avg(value) OVER m, 6) AS mean, max(value) OVER m AS most FROM f WINDOW m AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"),
    ("w23_advantage", gae, f"""
        WITH RECURSIVE {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f),
        r AS (SELECT episode, frame, value / 100 - value / 200 AS adv, value / 200 AS v FROM n WHERE frame = n - 1
              UNION ALL
              SELECT n.episode, n.frame, n.value / 100 + CASE WHEN n.event_type = 'signup' THEN 0 ELSE 0.9::DOUBLE * r.v END - n.value / 200 + CASE WHEN n.event_type = 'signup' THEN 0 ELSE 0.9::DOUBLE * 0.8::DOUBLE * r.adv END, n.value / 200
              FROM r JOIN n ON n.episode = r.episode AND n.frame = r.frame - 1)
        SELECT episode, frame, round(adv, 6) AS advantage FROM r"""),
    ("w28_prefix_ends", prefix_ends, """
        WITH n AS (SELECT user_id AS episode, count(*) AS n FROM events GROUP BY 1), i AS (SELECT episode, n, unnest(range(1, n)) AS i FROM n),
        s AS (SELECT episode, n, i, CAST('0x' || substr(md5('prefix|' || episode || '|' || i), 1, 8) AS BIGINT) % 3 + 2 AS step FROM i),
        p AS (SELECT episode, n, step, CAST(sum(step) OVER (PARTITION BY episode ORDER BY i) AS BIGINT) AS gone FROM s)
        SELECT episode, least(gone, n - 1) AS frame FROM p WHERE gone - step < n - 1 UNION ALL SELECT episode, 0 FROM n"""),
    ("w24_goals", goals, f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f), g AS (SELECT *, frame + 1 + CAST('0x' || substr(md5(event_id::VARCHAR), 1, 8) AS BIGINT) % (n - frame - 1) AS goal FROM n WHERE frame < n - 1) SELECT g.event_id, g.goal, f.event_id AS goal_event FROM g JOIN f ON f.episode = g.episode AND f.frame = g.goal"),
    ("w25_slots", slots, f"WITH {FRAMES}, u AS (SELECT episode, event_type, min(frame) AS first FROM f GROUP BY 1, 2) SELECT episode, event_type, dense_rank() OVER (PARTITION BY episode ORDER BY first) - 1 AS slot FROM u"),
    ("w26_memory_map", memory_map, "WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), p AS (SELECT conv_id, turn, 'B' AS kind, unnest(range(2)) AS token FROM t UNION ALL SELECT conv_id, turn, 'U', unnest(range(3)) FROM t WHERE turn < n - 1) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, token) - 1 AS place FROM p"),
    ("f12_f13_f14_idle", idle, f"WITH {FRAMES}, p AS (SELECT *, abs(value - coalesce(lag(value) OVER w, 0)) < 8 AS small, coalesce(lag(event_type) OVER w = event_type, true) AS same FROM f WINDOW w AS (PARTITION BY episode ORDER BY frame)) SELECT event_id FROM p WHERE NOT (small AND same)"),
    ("f18_shrunk", shrunk, f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f) SELECT event_id, frame - 3 AS frame FROM n WHERE frame >= 3 AND frame < n - 2"),
    ("v01_repeat_to_minimum", repeat_to_minimum, f"WITH {FRAMES}, p AS (SELECT episode, count(*) - 7 AS m FROM f GROUP BY 1), k AS (SELECT episode, m, unnest(range(greatest(m, 90))) AS k FROM p WHERE m > 0) SELECT episode, k, k % m AS sample FROM k"),
    ("v02_validity", validity, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n, arg_max(event_type, frame) AS e FROM f GROUP BY 1) SELECT episode, CASE WHEN e = 'error' THEN repeat('1', n) ELSE repeat('1', least(n, 40)) || repeat('0', greatest(n - 40, 0)) END AS mask FROM p"),
    ("v05_stride", stride, f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f) SELECT episode, frame FROM n WHERE frame % 4 = 0 AND frame <= n - 1 - (n - 1) % 4"),
    ("v08_v19_relative_chunk", relative_chunk, f"WITH {FRAMES}, n AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f), d AS (SELECT unnest(range(5)) AS d) SELECT a.event_id, {FMT.format('CASE WHEN d = 0 THEN b.value ELSE b.value - a.value END', 'd')} AS chunk FROM n a, d JOIN f b ON true WHERE b.episode = a.episode AND b.frame = least(a.frame + d, a.last) GROUP BY 1"),
    ("v14_pad_to", pad_to, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n, arg_min(event_id, frame) AS event_id FROM f GROUP BY 1) SELECT episode, frame, event_id, true AS valid FROM f UNION ALL SELECT episode, unnest(range(n, 100)), event_id, false FROM p WHERE n < 100"),
    ("v27_episodic", episodic, f"WITH {FRAMES} SELECT episode, count(*) AS n, {FMT.format('value', 'frame')} AS samples FROM f GROUP BY 1"),
]
