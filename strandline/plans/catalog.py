"""Registry of the named queries: each is a Spark function and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules whose ``QUERIES`` hold (name, function, sql or None).
MODULES = ("reports", "vectors", "aggregates", "sequences", "relations", "sampling", "shapes", "extras", "trajectories", "streams", "roundtrips")

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> list[tuple[str, Query, str | None]]:
    rows: list[tuple[str, Query, str | None]] = []
    for name in MODULES:
        rows += importlib.import_module(f"strandline.plans.{name}").QUERIES
    return rows


def queries() -> dict[str, Query]:
    return {name: f for name, f, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: inspect.cleandoc(sql) for name, _, sql in _all() if sql}
