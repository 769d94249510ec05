"""Sinks: every write goes through Spark's commit protocol; a folder that holds something is refused."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import slug
from strandline.operators.joins import offsets
from strandline.sources import folders, storage


def build_artifacts(path: str, **tables: DataFrame) -> None:
    """One JSON-lines folder per table; any that exists already raises before a row is written."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}.jsonl")


def by_folder(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a folder in one partition, folders spread over many: small files take time by their number, not by bytes."""
    return df.repartition(storage.tasks(df.sparkSession), *columns)


def document_files(df: DataFrame, path: str, task: str = "task", episode: str = "episode") -> None:
    """Documents in folders by task slug and episode: task=<slug>/episode=<number>/."""
    rows = df.withColumn("task", slug(F.col(task))).withColumn("episode", F.lpad(F.col(episode).cast("string"), 7, "0"))
    by_folder(rows, "task", "episode").write.mode("errorifexists").partitionBy("task", "episode").json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def episode_files(frames: DataFrame, path: str, episode: str = "episode") -> None:
    """A folder with one Parquet file for each episode: <episode>=<number>/."""
    spark = frames.sparkSession
    rows = by_folder(frames, episode).sortWithinPartitions(episode, "frame")
    at = storage.mounted(spark, path)
    if at is None or not folders.serves(frames.schema, episode):
        rows.write.mode("errorifexists").partitionBy(episode).parquet(path)
        return
    if os.path.exists(at):
        raise FileExistsError(f"{path} already exists")
    folders.register(spark)
    rows.write.format("parquet_folders").option("key", episode).mode("append").save(at)


def with_global_index(frames: DataFrame, episode: str, frame: str) -> DataFrame:
    """``index``: position in the whole data set, episodes end to end."""
    starts = offsets(frames.groupBy(episode).agg(F.count("*").alias("_n")), episode, "_n").select(episode, F.col("start").alias("_start"))
    return frames.join(starts, episode).withColumn("index", F.col("_start") + F.col(frame)).drop("_start")


def tensors(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Array columns as Parquet, with a metadata column that is the same in every row."""
    pairs = [F.lit(x) for pair in metadata.items() for x in pair]
    df.withColumn("metadata", F.create_map(*pairs)).write.mode("errorifexists").parquet(path)


def summary(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def convert(df: DataFrame, columns: dict[str, str], path: str) -> None:
    """Canonical schema (target name -> expression) written as Parquet: the shape of all format converters."""
    df.select(*[F.expr(e).alias(n) for n, e in columns.items()]).write.mode("errorifexists").parquet(path)


def track(metrics: DataFrame, path: str, run: str) -> None:
    """Append metrics (step, name, value) of a run to its log of JSON lines."""
    append_events(metrics.select(F.lit(run).alias("run"), "step", "name", F.col("value").cast("double").alias("value"), F.current_timestamp().alias("at")), path)


def tracked(logged: DataFrame) -> DataFrame:
    """(run, step, name, value): of values logged again for one step the last counts."""
    return logged.groupBy("run", "step", "name").agg(F.max_by("value", "at").alias("value"))


def episode_stats(frames: DataFrame, episode: str, values: list[str]) -> DataFrame:
    """(episode, stats): per value its min, max, mean, deviation and count, nested as metadata of an episode."""
    of = lambda v: F.struct(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"))
    return frames.groupBy(episode).agg(F.struct(*[of(v).alias(v) for v in values]).alias("stats"))


def moved_stats(frames: DataFrame, path: str, episode: str, values: list[str]) -> None:
    """Statistics moved out of the data set's summary into one JSON line per episode."""
    episode_stats(frames, episode, values).write.mode("errorifexists").json(path)
