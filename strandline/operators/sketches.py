"""Quantiles as mergeable state: a KLL sketch is a binary column that is built, stored and merged in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter: larger is more exact, and a sketch takes a few hundred bytes for each hundred of it.
K = 800


def rank_error(k: int = K) -> float:
    """How far, as a share of the rows, the rank of an answer may be off (in 99 of 100 cases), however often its sketch was
    merged: the published bound of the sketch for single quantiles."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, keys: list[str], values: dict[str, Column], k: int = K) -> DataFrame:
    """(keys, one sketch for each value, n): the state of each group. Null and NaN values are left out.

    Build it for episodes or batches and store it like any table; rows are added up before anything is shuffled.
    """
    finite = {name: F.when(~F.isnan(v.cast("double")), v.cast("double")) for name, v in values.items()}
    return df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(v, k).alias(name) for name, v in finite.items()], F.count("*").alias("n"))


def merged(states: DataFrame, keys: list[str], names: list[str], k: int = K) -> DataFrame:
    """The states of larger groups from those of smaller ones, or of old rows and new ones put together by a union."""
    return states.groupBy(*keys).agg(*[F.kll_merge_agg_double(name, k).alias(name) for name in names], F.sum("n").alias("n"))


def quantiles(states: DataFrame, name: str, shares: list[float], to: str = "quantiles") -> DataFrame:
    """``to``: the answers of a sketch for shares between 0 and 1, null for a sketch of nothing."""
    some = F.kll_sketch_get_n_double(name) > 0
    return states.withColumn(to, F.when(some, F.array(*[F.kll_sketch_get_quantile_double(name, F.lit(float(s))) for s in shares])))


def rank(states: DataFrame, name: str, value: Column, to: str = "rank") -> DataFrame:
    """``to``: the share of rows at or below a value."""
    return states.withColumn(to, F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_rank_double(name, value.cast("double"))))
