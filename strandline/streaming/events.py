"""Event logs as streams; every function has the batch form of the same plan as its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stage_counts(log: DataFrame) -> DataFrame:
    """Running counts and sums per event type (complete or update mode)."""
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def slots(log: DataFrame, seconds: str, late: str = "1 hour", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Time slots: the first value in ``order`` is the observation, the last one the action.

    Give the order of arrival for accumulators whose first arrival wins and whose action is overwritten: late data then
    rewrites a slot's action until the watermark passes, and never its observation.
    """
    timed = log.withColumn("time", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("time", late)
    came = F.struct(*order)
    return timed.groupBy("user_id", F.window("time", seconds).alias("slot")).agg(F.min_by("value", came).alias("observation"), F.max_by("value", came).alias("action"), F.count("*").alias("n"))


def windowed(log: DataFrame, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    timed = log.withColumn("time", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("time", late)
    return timed.groupBy(F.window("time", length, slide).alias("window"), "event_type").agg(F.count("*").alias("n"))


def sessions(log: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    timed = log.withColumn("time", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("time", late)
    return timed.groupBy("user_id", F.session_window("time", gap).alias("session")).agg(F.count("*").alias("n"), F.max("value").alias("most"))


def resumed(work: DataFrame, finished: DataFrame, ident: str, terminal: tuple[str, ...] = ("accepted", "rejected")) -> DataFrame:
    """Work that has no terminal status yet; everything else is done again."""
    return work.join(finished.filter(F.col("status").isin(*terminal)).select(ident), ident, "left_anti")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into a memory table and return it; a restart with the same checkpoint goes on after it."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into a Parquet table: each batch appends, or in complete mode replaces the last state.

    Batches go to folders by their number, so that a batch that runs again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = df.sparkSession.read.parquet(path)
    return found if mode == "complete" else found.drop("batch")
