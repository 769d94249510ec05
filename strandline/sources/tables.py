"""Parquet table access by folder and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (any path that Spark can read)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
