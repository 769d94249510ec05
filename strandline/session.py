"""Session defaults shared by tests, bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "strandline", master: str | None = None, **extra: str) -> SparkSession:
    """A UTC, adaptive session; on a cluster the submitter's settings win for everything not named here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
