"""Operational and evaluation reports as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, of keys that have as many; ``rank`` from 1."""
    w = Window.partitionBy(*keys)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("_size", F.count("*").over(w)).filter((F.col("_size") >= n) & (F.col("rank") <= n)).drop("_size")


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in the given total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_r = 1").drop("_r")


def score_text(score: Column, places: int = 4) -> Column:
    """A score without trailing zeros: 0.5000 -> 0.5, 1.0000 -> 1."""
    fixed = F.format_string(f"%.{places}f", score)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def score_distribution(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Counts per rounded score and the text "n x score, ..." from the highest score down."""
    counted = df.groupBy(*keys, F.round(score, 4).alias("score")).agg(F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("score", "n")), asc=False)
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["n"].cast("string"), F.lit(" x "), score_text(p["score"]))), ", ")
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_scores"), text.alias("distribution"))


def classifier_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and positive rate; no denominator is under 1e-6."""
    floor = lambda x: F.greatest(x.cast("double"), F.lit(1e-6))
    precision, recall = tp / floor(tp + fp), tp / floor(tp + fn)
    return {
        "accuracy": (tp + tn) / floor(tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / floor(precision + recall),
        "positive_rate": (tp + fp) / floor(tp + fp + fn + tn),
    }


def counts_from_rates(recall: Column, precision: Column, positives: Column) -> dict[str, Column]:
    tp = recall * positives
    return {"tp": tp, "fp": tp * (1 / precision - 1), "fn": positives - tp}


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """``advantage``: reward minus the group's mean over its sample deviation."""
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + eps))
