"""Small files on whatever file system Spark knows: metadata, never rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries, none if there is no folder."""
    place, system = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read(spark: SparkSession, path: str) -> str:
    place, system = _place(spark, path)
    size = system.getFileStatus(place).getLen()
    stream = system.open(place)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    place, system = _place(spark, path)
    out = system.create(place, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file: it appears whole, and of several callers one makes it.

    The text goes to a file beside it, which gets the name if nothing has it: by a hard link on a local file system, where
    renaming replaces, and by a rename that does not replace elsewhere. That is atomic on HDFS and the like; an object
    store without such a rename does not serve.
    """
    place, system = _place(spark, path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    write(spark, beside, text)
    try:
        if system.getScheme() == "file":
            try:
                os.link(local(system.makeQualified(_place(spark, beside)[0]).toUri().toString()), local(system.makeQualified(place).toUri().toString()))
                return True
            except FileExistsError:
                return False
        return not system.exists(place) and system.rename(_place(spark, beside)[0], place)
    finally:
        delete(spark, beside)


def tasks(spark: SparkSession) -> int:
    """Tasks that share work which is counted in files rather than bytes: Spark would join partitions of few bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Readers that are made inside list their folders by a few tasks.

    Spark takes a task for each folder, up to 10,000, and starting one costs more than many listings.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if Spark takes it for one of the local file system, else None."""
    place, system = _place(spark, path)
    return local(system.makeQualified(place).toUri().toString()) if system.getScheme() == "file" else None


def local(path: str) -> str:
    """The path of a mounted file system without its scheme; other schemes raise."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not on a mounted file system")
    return unquote(parts.path) if parts.scheme else path
