"""Tables that streams keep: a folder for each batch number, so that a batch that runs again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.ranks import position

#: Places of one window task.
PLACES = 1 << 16


class Batches:
    """Rows written batch by batch; ``schema`` is that of a row without its batch number."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, before: int | None = None, only: int | None = None) -> DataFrame:
        """Rows with ``batch``: of all batches, of those before a number, or of one."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if only is None else f"{self.path}/batch={only}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        found = self.spark.read.schema(f"{self.schema}, batch int").parquet(self.path)
        if only is not None:
            return found.filter(F.col("batch") == only)
        return found if before is None else found.filter(F.col("batch") < before)

    def latest(self, keys: list[str], before: int | None = None) -> DataFrame:
        """Of each key the row of the last batch that wrote it."""
        found = self.read(before)
        rest = [c for c in found.columns if c not in (*keys, "batch")]
        return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")

    def compact(self, keys: list[str]) -> None:
        """One folder with the latest rows instead of many, for readers of a stopped stream."""
        number = self.read().agg(F.max("batch")).first()[0]
        if number is None:
            return
        self.latest(keys).write.mode("overwrite").parquet(f"{self.path}-compacted/batch={number}")
        files, here = self.spark._jvm.org.apache.hadoop.fs.Path, self.path
        system = files(here).getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.rename(files(here), files(f"{here}-old"))
        system.rename(files(f"{here}-compacted"), files(here))
        system.delete(files(f"{here}-old"), True)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, batch by batch; a later call with the same checkpoint goes on after it."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(changes: DataFrame, table: Batches, checkpoint: str) -> None:
    """Keep the changed rows of an aggregate in update mode; late rows rewrite a group until the watermark passes."""
    run_batches(changes, table.write, checkpoint, "update")


def moving_means(batch: DataFrame, carried: DataFrame, key: str, ident: str, value: str, length: int) -> DataFrame:
    """(key, seen, value, mean, new): a batch's values numbered after those that were carried, each with the mean of the
    last ``length`` values of its key.

    ``ident`` is an integer and orders a batch. Numbers come from ranks inside blocks and windows look at blocks of
    places with the end of the block before, so that a hot key is many tasks.
    """
    size = max(PLACES, length)
    seen = carried.groupBy(F.col(key).alias("_key")).agg(F.max("seen").alias("_seen"))
    ranked = position(batch.select(key, ident, value), ident, [key]).drop("total")
    new = ranked.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, (F.coalesce("_seen", F.lit(0)) + F.col("rank") + 1).alias("seen"), F.col(value).alias("value"), F.lit(True).alias("new"))
    rows = new.unionByName(carried.select(key, "seen", "value", F.lit(False).alias("new")))
    block = F.floor(F.col("seen") / size)
    here = F.array(F.struct(block.alias("at"), F.lit(True).alias("own")))
    both = F.when(F.col("seen") % size > size - length, F.concat(here, F.array(F.struct((block + 1).alias("at"), F.lit(False).alias("own"))))).otherwise(here)
    spread = rows.withColumn("_b", F.explode(both)).select("*", "_b.*").drop("_b")
    window = Window.partitionBy(key, "at").orderBy("seen").rowsBetween(-(length - 1), 0)
    return spread.withColumn("mean", F.avg("value").over(window)).filter("own").select(key, "seen", "value", "mean", "new")


def run_moving_mean(log: DataFrame, key: str, ident: str, value: str, length: int, every: int, path: str, checkpoint: str) -> DataFrame:
    """(key, seen, mean): the mean of a key's last ``length`` values, given out after each ``every`` of them.

    Values count in order of arrival, those of one batch in order of ``ident``. A batch reads the ends of all keys that
    the batch before has written, and writes its own.
    """
    spark, kind = log.sparkSession, dict(log.dtypes)[key]
    ends = Batches(spark, f"{path}/ends", f"{key} {kind}, seen long, value double")
    means = Batches(spark, f"{path}/means", f"{key} {kind}, seen long, mean double")

    def write(batch: DataFrame, number: int) -> None:
        rows = moving_means(batch, ends.read(only=number - 1), key, ident, value, length).persist()
        means.write(rows.filter("new").filter(F.col("seen") % every == 0).select(key, "seen", "mean"), number)
        last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("seen").alias("_last"))
        kept = rows.join(last, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("seen") > F.col("_last") - max(1, length - 1))
        ends.write(kept.select(key, "seen", F.col("value").cast("double").alias("value")), number)
        rows.unpersist()

    run_batches(log, write, checkpoint)
    return means.read().drop("batch")


def run_attempts(work: DataFrame, ident: str, attempt: Callable[[DataFrame], DataFrame], table: Batches, checkpoint: str, terminal: tuple[str, ...] = ("accepted", "rejected")) -> DataFrame:
    """(ident, attempts, status) of work that comes as a stream, after everything that is there has been tried.

    A batch tries what is new and what has failed for technical reasons so far; ``attempt`` turns (ident, attempt) into
    (ident, status). Work with a terminal status is never tried again, also if it comes again. A batch that was
    interrupted is tried again as the same batch: its outcomes replace those that it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = table.latest([ident], before=number)
        fresh = batch.select(ident).distinct().join(known.select(ident), ident, "left_anti").select(ident, F.lit(1).cast("long").alias("attempt"))
        again = known.filter(~F.col("status").isin(*terminal)).select(ident, (F.col("attempts") + 1).alias("attempt"))
        due = fresh.unionByName(again)
        done = attempt(due).select(ident, "status")
        table.write(due.join(done, ident).select(ident, F.col("attempt").alias("attempts"), "status"), number)

    run_batches(work, write, checkpoint)
    return table.latest([ident])
