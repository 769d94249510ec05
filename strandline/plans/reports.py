"""Operational reports over the driver tables (event log, scores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.stats import exact_quantiles
from strandline.sources.tables import table


def latency_percentiles(spark, root):
    """Count, exact linear p50/p95 (3 places) and max of ``value`` per event type."""
    events = table(spark, root, "events")
    ends = exact_quantiles(events, "value", ["event_type"], {"p50": 0.5, "p95": 0.95})
    plain = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return plain.join(ends, "event_type", "left").select("event_type", "n", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), "max_value")


QUERIES = [
    (
        "a03_latency_percentiles",
        latency_percentiles,
        """
        SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 3) AS p50,
               round(quantile_cont(value, 0.95), 3) AS p95, max(value) AS max_value
        FROM events GROUP BY event_type
        """,
    ),
]
