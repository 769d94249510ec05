"""Dataset editing: merge, split, delete, reindex."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranks import position
from strandline.operators.sampling import ranked


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union over the columns that all parts have, with ``dataset_index``."""
    common = [col for col in parts[0].columns if all(col in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*common, F.lit(i).alias("dataset_index")) for i, p in enumerate(parts)])


def reindex(df: DataFrame, key: str, name: str, before: list[str] | None = None) -> DataFrame:
    """``name``: dense numbers from 0 of the distinct integer keys, in order of ``before`` (few values) and key."""
    on = [*(before or []), key]
    local = position(df.select(*on).distinct(), key, before or [], name="_local", total="_size")
    if before:
        sizes = local.select(*before, "_size").distinct()
        base = sizes.select(*before, (F.sum("_size").over(Window.orderBy(*before)) - F.col("_size")).alias("_base"))
        local = local.join(base, before)
    else:
        local = local.withColumn("_base", F.lit(0))
    return df.join(local.select(*on, (F.col("_base") + F.col("_local")).cast("long").alias(name)), on)


def delete(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Without the listed keys, the rest renumbered."""
    return reindex(df.join(gone, key, "left_anti"), key, f"new_{key}")


def split(df: DataFrame, key: str, fractions: dict[str, float], *seed) -> DataFrame:
    """``split`` of each distinct key by seeded rank; what the fractions leave has none."""
    keys = ranked(df.select(key).distinct(), [], key, *seed)
    case = F.lit(None).cast("string")
    for name, fraction in reversed(list(_running(fractions))):
        case = F.when(F.col("rank") < F.floor(F.col("total") * fraction + 1e-9), name).otherwise(case)
    return df.join(keys.select(key, case.alias("split")), key)


def _running(fractions: dict[str, float]):
    total = 0.0
    for name, f in fractions.items():
        total += f
        yield name, total
