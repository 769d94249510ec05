"""Streaming queries: the event log as a stream, run to its end; plain SQL over the same log is the oracle."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from strandline.plans.common import fresh_folder
from strandline.sources.tables import table
from strandline.streaming import budget as B
from strandline.streaming import events as E
from strandline.streaming import tables as T

c = F.col

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _run(spark, root, make, mode):
    """The last state of a streaming plan over the log, as a table in the shared folder."""
    at = fresh_folder(spark, "stream")
    log = E.read_log(spark, f"{root}/event*.parquet", SCHEMA)
    return E.run_to_table(make(log), f"{at}/out", f"{at}/checkpoint", mode)


def counts(spark, root):
    return _run(spark, root, E.stage_counts, "complete").select("event_type", "n", F.round("total", 4).alias("total"), "most")


def slots(spark, root):
    out = _run(spark, root, lambda log: E.slots(log, "12 hours"), "complete")
    return out.select("user_id", F.unix_micros("slot.start").alias("slot"), "observation", "action", "n")


def sliding(spark, root):
    out = _run(spark, root, lambda log: E.windowed(log, "2 days", "1 day"), "complete")
    return out.select(F.unix_micros("window.start").alias("start"), "event_type", "n")


def sessions(spark, root):
    out = _run(spark, root, lambda log: E.sessions(log, "1 day", "60 days"), "complete")
    return out.select("user_id", F.unix_micros("session.start").alias("start"), "n", "most")


def _arriving(spark, root, part):
    """The log as three files that arrive one after another: (stream, path); ``part`` tells the file, from 0."""
    at = fresh_folder(spark, "arriving")
    log = table(spark, root, "events").withColumn("part", part.cast("long"))
    for i in range(3):  # the file source takes the oldest file first
        log.filter(c("part") == i).coalesce(1).write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema(f"{SCHEMA}, part long").option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
    return stream, at


def budget(spark, root):
    """Fifty calls of each event type over three batches."""
    stream, at = _arriving(spark, root, F.floor(c("event_id") * 3 / (table(spark, root, "events").count() + 1)))
    with B.state_on_disk(spark):
        return E.run_to_table(B.call_budget(stream, "event_type", "event_id", 50), f"{at}/out", f"{at}/checkpoint")


def moving(spark, root):
    at = fresh_folder(spark, "stream")
    log = E.read_log(spark, f"{root}/event*.parquet", SCHEMA)
    return T.run_moving_mean(log, "event_type", "event_id", "value", 50, 25, at, f"{at}/checkpoint").select("event_type", "seen", F.round("mean", 6).alias("mean"))


def late_slots(spark, root):
    """Slots in update mode: a seventh of the events arrives with the third file and rewrites the actions of its slots."""
    stream, at = _arriving(spark, root, F.when(c("event_id") % 7 == 0, 2).otherwise(c("event_id") % 2))
    held = T.Batches(spark, f"{at}/slots", "user_id long, slot struct<start timestamp, end timestamp>, observation double, action double, n long")
    T.upsert(E.slots(stream, "12 hours", "1000 days", ("part", "event_id")), held, f"{at}/checkpoint")
    return held.latest(["user_id", "slot"]).select("user_id", F.unix_micros("slot.start").alias("slot"), "observation", "action", "n")


def resumed(spark, root):
    """Work in three batches whose second is interrupted after it wrote: it runs again, failures are tried once more in
    each later batch, and what was accepted or rejected is left alone."""
    stream, at = _arriving(spark, root, c("event_id") % 3)
    values = table(spark, root, "events").select("event_id", "value")
    outcomes = T.Batches(spark, f"{at}/outcomes", "event_id long, attempts long, status string")

    def attempt(due):
        failed = (c("event_id") * 7 + c("attempt") * 3) % 10 < 4
        return due.join(values, "event_id").select("event_id", F.when(failed, "technical").when(c("value") > 50, "accepted").otherwise("rejected").alias("status"))

    class Interrupted(T.Batches):
        def write(self, rows, number):
            super().write(rows, number)
            if number == 1:
                raise InterruptedError

    try:
        T.run_attempts(stream, "event_id", attempt, Interrupted(spark, outcomes.path, outcomes.schema), f"{at}/checkpoint")
    except StreamingQueryException as e:
        if "InterruptedError" not in str(e):
            raise
    return T.run_attempts(stream, "event_id", attempt, outcomes, f"{at}/checkpoint")


QUERIES = [
    ("x01_stream_counts", counts, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1"),
    ("x06_stream_slots", slots, "SELECT user_id, epoch_us(time_bucket(INTERVAL 12 hours, ts)) AS slot, arg_min(value, (ts, event_id)) AS observation, arg_max(value, (ts, event_id)) AS action, count(*) AS n FROM events GROUP BY 1, 2"),
    ("x_stream_sliding", sliding, "WITH b AS (SELECT epoch_us(time_bucket(INTERVAL 1 day, ts)) AS d, event_type FROM events) SELECT d - k * 86400000000 AS start, event_type, count(*) AS n FROM b, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2"),
    ("x_stream_sessions", sessions, "WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 day THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, max(value) AS most FROM s GROUP BY user_id, k"),
    ("x05_stream_moving", moving, "WITH w AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seen, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean FROM events) SELECT event_type, seen, round(mean, 6) AS mean FROM w WHERE seen % 25 = 0"),
    ("x03_stream_resumed", resumed, """
        WITH a AS (SELECT event_id, value, event_id % 3 AS part, unnest(range(1, CAST(4 - event_id % 3 AS BIGINT))) AS attempt FROM events),
        t AS (SELECT *, CASE WHEN (event_id * 7 + attempt * 3) % 10 < 4 THEN 'technical' WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS status FROM a),
        f AS (SELECT event_id, min(attempt) FILTER (status <> 'technical') AS good, max(attempt) AS last FROM t GROUP BY 1)
        SELECT t.event_id, attempt AS attempts, status FROM t JOIN f ON f.event_id = t.event_id AND attempt = coalesce(good, last)"""),
    ("x06_stream_late_slots", late_slots, "WITH a AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 2 ELSE event_id % 2 END AS part FROM events) SELECT user_id, epoch_us(time_bucket(INTERVAL 12 hours, ts)) AS slot, arg_min(value, (part, event_id)) AS observation, arg_max(value, (part, event_id)) AS action, count(*) AS n FROM a GROUP BY 1, 2"),
    ("x02_stream_budget", budget, "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_type, event_id, CASE WHEN k <= 50 THEN k END AS call, CASE WHEN k <= 50 THEN 'reserved' ELSE 'exhausted' END AS status FROM r"),
]
