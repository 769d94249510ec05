"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, neardup, packing, quality, suffix
from strandline.llm._shared import scratch

#: No SQL expresses best-fit packing or quality references; tests compare with brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of repeated 100-byte strings; documents that have no word left go."""
    short = suffix.dedup(docs)
    left = short.filter(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs, added=packing.default_added()))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on; what a stage has written on its way is deleted once its result is written.

    Every stage says what it does with nulls, empty and very long texts, repeated rows, ties and empty tables. In short:
    a null or empty text fails the quality rules; rows that agree in id and text are one document, of which one row
    stays; rows of one id with different texts are documents of their own; an empty table gives an empty result, and so
    does one of which no document is kept. Columns beyond those of ``documents`` reach the fourth stage unchanged.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep_last:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep_last(docs, "pipeline")
