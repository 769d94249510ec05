"""What the operators share: written tables in the cluster's shared folder, document keys, Arrow access, hash buckets."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Input bytes that one bucket (one reduce task) is meant to get: from the first to the second as the input grows.
BUCKET_BYTES = 12 << 20, 256 << 20
#: The key of a null id: less than any other.
NULL_KEY = -(1 << 63)
#: Distinct (id, text) pairs of one block, where keys have to be ranked.
KEY_ROWS = 1_000_000

_local_dirs: dict[str, str] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dirs.get(context.applicationId) or tempfile.mkdtemp(prefix="strandline-")
        _local_dirs[context.applicationId] = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    scopes = getattr(_scopes, "open", None)
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that the block writes are deleted at its end, but for those written by the function that it yields.

    What leaves the block must be such a table, or nothing that still reads one of the others.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    made: list[str] = []
    scopes.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        path = made.pop()
        if len(scopes) > 1:
            scopes[-2].append(path)
        return out

    try:
        yield keep
    finally:
        scopes.pop()
        remove(spark, made)


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "_key") -> tuple[DataFrame, bool]:
    """(``docs`` with a long ``name``, whether rows share one): a key for each document, in order of id (null first), then
    of its text's digest.

    Rows that agree in id and text (null counts as empty) are one document and share the key; rows that repeat an id
    with another text are documents of their own. Integer ids without repeats are keys themselves; the check for
    repeats moves ids only. Otherwise (id, digest) pairs are ranked and joined to the rows.
    """
    ident = F.col(id_col)
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        own = F.coalesce(ident.cast("long"), F.lit(NULL_KEY))
        if docs.select(own.alias("k")).groupBy("k").count().filter("count > 1").isEmpty():
            return docs.withColumn(name, own), False
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    with scratch(docs.sparkSession) as keep:
        pairs = written(docs.groupBy(ident.alias("_id"), digest.alias("_digest")).agg(F.count("*").alias("_rows")), "pairs")
        repeated = not pairs.filter("_rows > 1").isEmpty()
        parts = max(1, -(-pairs.count() // KEY_ROWS))
        order = [F.asc_nulls_first("_id"), F.asc("_digest")]
        dealt = written(pairs.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "pairs-by-range")
        # one row for each KEY_ROWS pairs
        sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
        bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        keys = dealt.withColumn("_place", place).join(bases, "_part").select("_id", "_digest", (F.col("_base") + F.col("_place")).cast("long").alias(name))
        keys = keep(keys, "keys")
    rows = docs.withColumn("_own_digest", digest)
    same = rows[id_col].eqNullSafe(keys["_id"]) & (rows["_own_digest"] == keys["_digest"])
    return rows.join(keys.hint("merge"), same).select(*(rows[c] for c in docs.columns), keys[name]), repeated


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def bucket_count(n_bytes: int) -> int:
    per_bucket = min(BUCKET_BYTES[1], max(BUCKET_BYTES[0], n_bytes // 2000))
    return max(8, -(-n_bytes // per_bucket))


def by_bucket(blobs: DataFrame, n: int, column: str | Column = "bucket") -> DataFrame:
    """Bucket i in partition i: no task holds two buckets at once."""
    return blobs.repartitionById(n, F.col(column) if isinstance(column, str) else column)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (nulls are empty) and the n + 1 offsets of its values."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer value stays whole."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def split_blobs(bucket: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed records of each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
        if b > a:
            yield int(bucket[a]), records[a:b].tobytes()


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a sorted key differs from the one before."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new
