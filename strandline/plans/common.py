"""What the query modules share: tables in the shape of episodes, and the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources import storage
from strandline.sources.tables import table


def frames(spark, root):
    """Events as frames: an episode is a user, its order is (ts, event_id), ``frame`` counts from 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, root, "events").select(
        F.col("user_id").alias("episode"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "event_id", "ts", "event_type", "value", "props"
    )


#: Folders that queries of this process have made.
_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the files of a query below ``spark.checkpoint.dir``; on one machine without it a temporary one.

    A query's result reads its folder, so it stays until ``delete_folders``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def delete_folders(spark: SparkSession) -> None:
    """Delete what queries have written so far; their results can't be read any more."""
    while _made:
        storage.delete(spark, _made.pop())


#: CTE ``f``: the same frames.
FRAMES = """f AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
                  event_id, ts, event_type, value, props FROM events)"""
#: CTEs ``e`` (long-form embeddings) and ``s`` (their exact statistics).
VECTORS = """e AS (SELECT vec_id, label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
     s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi,
                  quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM e GROUP BY dim)"""
