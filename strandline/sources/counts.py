"""Row counts of files, kept in an index that is read instead of files that have not changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.files import numbered_lines
from strandline.sources.snapshots import SnapshotTable

STAMP = ["path", "length", "modified"]


def listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder; contents are not read. Spark lists no empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("modified"))


def line_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rows): lines that are not blank."""
    lines = numbered_lines(spark, paths)
    # metadata says file:/// where listings say file:/
    path = F.regexp_replace("_file", "^file:/+", "file:/")
    return lines.groupBy(path.alias("path")).agg(F.count_if(F.trim("raw") != "").alias("rows"))


def refreshed(spark: SparkSession, path: str, index: SnapshotTable, pattern: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(index rows (path, length, modified, rows), files by what was done with them).

    Only files that are new, or whose length or time of change differs, are read; files that are gone leave the index. The
    paths of files to be read pass through the driver. An index in which nothing changed stays at its version.
    """
    now = listed(spark, path, pattern).persist()
    try:
        if index.manifest() is None:
            known, version = spark.createDataFrame([], "path string, length long, modified long, rows long"), None
        else:
            version = index.manifest().version
            known = index.read(version)
        same = now.join(known, STAMP)
        stale = [r.path for r in now.join(known, STAMP, "left_anti").select("path").collect()]
        done = {"read": len(stale), "kept": same.count(), "gone": known.join(now, "path", "left_anti").count()}
        if not stale and not done["gone"] and version is not None:
            return known, done
        kept = same.select(*STAMP, "rows")
        if stale:
            counted = now.join(known, STAMP, "left_anti").join(line_counts(spark, stale), "path", "left")
            kept = kept.unionByName(counted.select(*STAMP, F.coalesce("rows", F.lit(0).cast("long")).alias("rows")))
        return index.read(index.replace(kept, expected=-1 if version is None else version)), done
    finally:
        now.unpersist()
