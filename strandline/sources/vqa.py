"""Question-answer records over images: JSON lines whose image paths are looked up in several places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.files import numbered_lines

TURNS = "array<struct<`from`: string, value: string>>"


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of one file.

    A record: ``line`` from 1, ``conversations`` (from, value), ``images``, the paths in order (a single path or a list;
    nulls among them are left out), ``data_path`` and ``source``. Blank lines are skipped; bad JSON and records without
    an image are violations (line, reason).
    """
    v = F.try_parse_json("raw")
    lines = numbered_lines(spark, path).filter(F.trim("raw") != "").select(F.col("_line").alias("line"), v.alias("_v"))
    one, many = F.try_variant_get("_v", "$.image", "string"), F.try_variant_get("_v", "$.image", "array<string>")
    images = F.filter(F.coalesce(many, F.array(one)), lambda x: x.isNotNull())
    found = lines.select(
        "line", F.try_variant_get("_v", "$.conversations", TURNS).alias("conversations"), images.alias("images"),
        F.try_variant_get("_v", "$.data_path", "string").alias("data_path"), F.try_variant_get("_v", "$.source", "string").alias("source"),
        F.when(F.col("_v").isNull(), "bad JSON").when(F.size(images) == 0, "no image").alias("reason"),
    )
    return found.filter("reason is null").drop("reason"), found.filter("reason is not null").select("line", "reason")


def _under(folder, path):
    """A path below a folder, or itself if it is absolute or has a scheme."""
    return F.when(path.rlike("^(/|[a-z][a-z0-9]*:)"), path).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), path))


def plain_path(path):
    """``file:///a`` and ``file:/a`` as ``/a``."""
    return F.regexp_replace(path, "^file:/+", "/")


def resolved(found: DataFrame, files: DataFrame, beside: str, root: str | None) -> tuple[DataFrame, DataFrame]:
    """(records with ``images`` as whole paths, violations).

    An image is looked for, in this order, where it says itself if it is absolute, beside the JSON lines (``beside``), in
    ``data_path`` below ``root``, in ``data_path`` and in ``root``. ``files`` (path) lists what there is, so a look is a
    join and not a question to the file system for each image. A record of which an image is nowhere is a violation.
    """
    image = found.select("line", "data_path", F.posexplode("images").alias("place", "image"))
    here = [F.when(F.col("image").startswith("/"), F.col("image")), _under(F.lit(beside), F.col("image"))]
    data = F.when(F.col("data_path") != "", F.col("data_path"))
    if root is not None:
        here.append(_under(_under(F.lit(root), data), F.col("image")))
    here.append(_under(data, F.col("image")))
    if root is not None:
        here.append(_under(F.lit(root), F.col("image")))
    tried = image.select("line", "place", "image", F.posexplode(F.array(*here)).alias("rank", "path")).filter("path is not null").withColumn("path", plain_path(F.col("path")))
    known = files.select(plain_path(F.col("path")).alias("path")).distinct()
    best = tried.join(known, "path").groupBy("line", "place").agg(F.min_by("path", "rank").alias("path"))
    met = image.join(best, ["line", "place"], "left")
    lost = met.filter("path is null").groupBy("line").agg(F.concat(F.lit("image not found: "), F.min_by("image", "place")).alias("reason"))
    whole = met.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("_i"), F.count_if(F.col("path").isNull()).alias("_lost")).filter("_lost = 0")
    return found.drop("images").join(whole.select("line", F.col("_i.path").alias("images")), "line"), lost
