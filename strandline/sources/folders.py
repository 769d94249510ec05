"""Parquet files in a folder for each value of a whole-number column, as ``partitionBy`` lays them out.

Hadoop's local file system, without its native library, starts a ``chmod`` for each permission that it sets: three for each
folder with one file. The writer here starts none. Spark's reader keeps what it lists in the driver, near a kilobyte a file,
and its partition discovery looks up the values of n folders in a list by their place, which takes time by n squared. The
reader here keeps the folders' names. Both serve paths that all nodes mount; other stores set permissions by a call and
are written and read by Spark's own (``sinks.episode_files`` and ``read`` choose).
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.sources import storage
from strandline.sources.storage import local

#: Spark's name of the folder of a null.
NULL = "__HIVE_DEFAULT_PARTITION__"
#: Rows and bytes of one row group at most, so that a folder of any size is written in bounded memory.
ROWS, BYTES = 1 << 20, 32 << 20
#: Rows that are read at once.
BATCH = 1 << 14
#: Types that Arrow writes to Parquet as Spark does.
ALIKE = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _alike(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return len(t) > 0 and all(_alike(f.dataType) for f in t)
    if isinstance(t, T.MapType):
        return _alike(t.keyType) and _alike(t.valueType)
    if isinstance(t, T.ArrayType):
        return _alike(t.elementType)
    return isinstance(t, ALIKE) and "collate" not in t.simpleString()


def serves(schema: T.StructType, key: str) -> bool:
    """Whether rows of this schema come out as from Spark's writer: a key of whole numbers, and types that are alike."""
    whole = any(isinstance(f.dataType, T.IntegralType) for f in schema if f.name == key)
    return whole and re.fullmatch(r"\w+", key, re.ASCII) is not None and len(schema) > 1 and _alike(schema)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class Writer(DataSourceArrowWriter):
    """Tasks write their folders beside, under names that readers skip; the commit moves those of the tasks that count."""

    def __init__(self, options: dict):
        self.path, self.key, self.job = local(options["path"]), options["key"], uuid.uuid4().hex
        self.beside = os.path.join(self.path, f".written-{self.job}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows that come ordered by the key."""
        folder = os.path.join(self.beside, uuid.uuid4().hex)
        os.makedirs(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.parquet"
        key, writer, held, size, rows = None, None, [], 0, 0
        try:
            for batch in batches:
                runs = pc.run_end_encode(batch.column(self.key))
                batch, start = batch.drop_columns([self.key]), 0
                for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                    if writer is None or value != key or rows >= ROWS or size >= BYTES:
                        if held:
                            writer.write_table(pa.Table.from_batches(held))
                        held, size, rows = [], 0, 0
                    if writer is None or value != key:
                        if writer is not None:
                            writer.close()
                        one = os.path.join(folder, f"{self.key}={NULL if value is None else value}")
                        os.mkdir(one)  # a key that comes twice raises: its rows were not in order
                        writer, key = pq.ParquetWriter(os.path.join(one, name), batch.schema, store_schema=False), value
                    held.append(batch.slice(start, end - start))
                    size, rows, start = size + held[-1].nbytes, rows + end - start, end
            if held:
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer is not None:
                writer.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            with os.scandir(m.folder) as found:
                for one in found:
                    os.rename(one.path, os.path.join(self.path, one.name))  # raises if another task wrote the key too
        shutil.rmtree(self.beside, ignore_errors=True)  # of tasks that do not count
        os.makedirs(self.path, exist_ok=True)
        open(os.path.join(self.path, "_SUCCESS"), "w").close()

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


@dataclass
class Part(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    """A task reads its share of the folders, file by file; small files are handed on together."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.key, self.tasks = schema, local(options["path"]), options["key"], int(options["tasks"])

    def partitions(self) -> list[Part]:
        with os.scandir(self.path) as found:
            names = sorted(one.name for one in found if one.name.startswith(f"{self.key}="))
        size = -(-len(names) // self.tasks) or 1
        return [Part(names[i : i + size]) for i in range(0, len(names), size)] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        columns = [n for n in target.names if n != self.key]
        held, size = [], 0
        for name in part.names:
            value = name[len(self.key) + 1 :]
            value = pa.scalar(None if value == NULL else int(value), target.field(self.key).type)
            for file in sorted(os.listdir(os.path.join(self.path, name))):
                if file.startswith((".", "_")):
                    continue
                with pq.ParquetFile(os.path.join(self.path, name, file), coerce_int96_timestamp_unit="us") as rows:
                    for batch in rows.iter_batches(batch_size=BATCH, columns=columns, use_threads=False):
                        keys = pa.repeat(value, batch.num_rows)
                        found = [keys if n == self.key else batch.column(n) for n in target.names]
                        held.append(pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(found, target)], schema=target))
                        size += batch.num_rows
                        if size >= BATCH:
                            yield pa.concat_batches(held)
                            held, size = [], 0
        if held:
            yield pa.concat_batches(held)


class Folders(DataSource):
    """Options ``path`` and ``key``, the column whose values are the folders. Writing: rows of a key are one task's, in its
    order. Reading: ``tasks``, so many share the folders; a folder is one task's."""

    @classmethod
    def name(cls) -> str:
        return "parquet_folders"

    def schema(self) -> str:
        raise ValueError("give the schema of the rows: spark.read.format('parquet_folders').schema(...)")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Folders)


def read(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of files in folders by a column of whole numbers, that column last; ``schema`` is the files'."""
    at = storage.mounted(spark, path)
    if at is not None:
        register(spark)
        return spark.read.format("parquet_folders").schema(f"{schema}, {key} long").option("key", key).option("tasks", storage.tasks(spark)).load(at)
    with storage.listing(spark):
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    value = F.regexp_extract("_metadata.file_path", f"/{re.escape(key)}=([^/]+)/[^/]+$", 1)
    return rows.withColumn(key, F.nullif(value, F.lit(NULL)).cast("long"))
