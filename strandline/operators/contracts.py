"""Contracts: predicates become tables of violations; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reason) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("reason"))


def assert_valid(found: DataFrame, limit: int = 20) -> None:
    """Raise with the first violations, if there are any."""
    rows = found.limit(limit).collect()
    if rows:
        raise ValueError("contract broken: " + "; ".join(str(tuple(r)) for r in rows))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).filter("n > 1")


def broken_sequences(df: DataFrame, episode: str, frame: str) -> DataFrame:
    """Episodes whose frames are not exactly 0 .. n - 1."""
    per = df.groupBy(episode).agg(F.count("*").alias("n"), F.min(frame).alias("lo"), F.max(frame).alias("hi"), F.countDistinct(frame).alias("d"))
    return per.filter((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")))


def exact_keys(json: Column, keys: list[str]) -> Column:
    """True if the JSON object has these keys and no others."""
    return F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)])


def safe_path(path: Column) -> Column:
    """Relative, without a parent step or a drive."""
    return ~path.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\") & (F.length(path) > 0)


def gate(df: DataFrame, status: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, quarantined, everything else, which is a violation)."""
    rows = df.withColumn("_status", status)
    known = F.coalesce(F.col("_status").isin("accepted", "quarantined"), F.lit(False))
    return rows.filter("_status = 'accepted'").drop("_status"), rows.filter("_status = 'quarantined'").drop("_status"), rows.filter(~known).withColumnRenamed("_status", "status")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as sets; ``side`` says whose they are."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def complete_chains(units: DataFrame, bounds: DataFrame, chain: str) -> DataFrame:
    """Chains whose units are all complete and have complete boundaries on both sides.

    ``units``: chain, before, after, complete; ``bounds``: chain, id, complete.
    """
    b = bounds.filter("complete").select(chain, "id")
    joined = units.join(b.withColumnRenamed("id", "before").withColumn("_b", F.lit(True)), [chain, "before"], "left").join(b.withColumnRenamed("id", "after").withColumn("_a", F.lit(True)), [chain, "after"], "left")
    good = F.col("complete") & F.coalesce("_b", F.lit(False)) & F.coalesce("_a", F.lit(False))
    return joined.groupBy(chain).agg(F.count("*").alias("units"), F.bool_and(good).alias("accepted"))


def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
