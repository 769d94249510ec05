"""Fail-closed file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import contracts as C
from strandline.sources.storage import listing

#: Bytes up to which one task numbers the lines of a whole file.
WHOLE = 4 << 20


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _line from 1, raw) of text files of any size; a file may be read by many tasks.

    Files of up to ``WHOLE`` bytes are read once, and their lines are ranked. Of larger files a task numbers the lines that
    it reads; those of one part of a file are numbered in a row, so a line's number is its place in its part and the lines
    of the file's earlier parts. The files are listed once, when this is called: all scans cut the same listing into the
    same parts, and files that are added later are in none.
    """
    with listing(spark):
        found = spark.read.text(path)
    size = F.col("_metadata.file_size")  # a filter of whole files, which are not opened
    columns = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("raw")]
    text, small = found.filter(size > WHOLE).select(*columns), found.filter(size <= WHOLE).select(*columns)
    ranked = small.select("_file", F.row_number().over(Window.partitionBy("_file").orderBy("_start", "_id")).cast("long").alias("_line"), "raw")
    parts = text.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")
    parts = parts.select("_file", "_start", "_first", before.alias("_before"))
    large = text.join(parts, ["_file", "_start"]).select("_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("_line"), "raw")
    return ranked.unionByName(large)


def checked_lines(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None) -> DataFrame:
    """(_file, _line, reason, r) of JSON lines in one pass: ``reason`` is null for records, ``r`` for violations.

    Blank lines, bad JSON, values that are no object and, with ``keys``, missing or extra keys are violations.
    """
    lines = numbered_lines(spark, path)
    is_object = F.coalesce(F.try_parse_json("raw").isNotNull() & F.json_object_keys("raw").isNotNull() & F.ltrim("raw").startswith("{"), F.lit(False))
    reason = F.when(F.trim("raw") == "", "blank line").when(F.try_parse_json("raw").isNull(), "bad JSON").when(~is_object, "no object")
    if keys is not None:
        reason = reason.when(~F.coalesce(C.exact_keys(F.col("raw"), keys), F.lit(False)), "wrong keys")
    checked = lines.withColumn("reason", reason)
    return checked.select("_file", "_line", "reason", F.when(F.col("reason").isNull(), F.from_json("raw", schema)).alias("r"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of JSON lines; whoever wants both at once reads the files once by ``checked_lines``.

    A record has ``_file`` and ``_line`` (from 1 inside its file), a violation file, line and reason.
    """
    checked = checked_lines(spark, path, schema, keys)
    records = checked.filter("reason is null").select("_file", "_line", "r.*")
    return records, checked.filter("reason is not null").select(F.col("_file").alias("file"), F.col("_line").alias("line"), "reason")


def one_record_files(records: DataFrame) -> DataFrame:
    """Violations: files that do not hold exactly one record."""
    return records.groupBy("_file").agg(F.count("*").alias("n")).filter("n <> 1")


def one_record_violations(checked: DataFrame) -> int:
    """Lines that are no record and files that hold several, of ``checked_lines`` in one pass."""
    per = checked.groupBy("_file").agg(F.count_if(F.col("reason").isNull()).alias("n"), F.count("reason").alias("bad"))
    return per.agg(F.coalesce(F.sum("bad") + F.count_if(F.col("n") > 1), F.lit(0))).first()[0]


def row_counts(records: DataFrame) -> DataFrame:
    """Rows per file, for an index that is stale when the files change."""
    return records.groupBy("_file").agg(F.count("*").alias("rows"))


def index_is_fresh(index: DataFrame, records: DataFrame) -> bool:
    """True if the stored counts are those of the files now."""
    return not C.differences(index.select("_file", "rows"), row_counts(records)).limit(1).count()


def info(spark: SparkSession, path: str, expected: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(metadata row, violations) of a multi-line JSON document whose scalars must equal ``expected``."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    key = df.withColumn("_key", F.lit(path))
    rules = {name: (F.col(name) == F.lit(value)) if name in df.columns else F.lit(False) for name, value in expected.items()}
    return df, C.violations(key, "_key", rules)


def tasks(df: DataFrame, candidates: tuple[str, ...] = ("task", "task_description", "name")) -> tuple[DataFrame, DataFrame]:
    """((text, task_index), violations): the first text column there is; blank and repeated texts are violations."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of the columns {candidates}")
    t = df.select(F.trim(F.col(name)).alias("text"), F.col("task_index").cast("long").alias("task_index"))
    blank = t.filter(F.coalesce(F.length("text"), F.lit(0)) == 0).select("task_index", F.lit("blank").alias("reason"))
    twice = t.join(C.duplicates(t, "text").select("text"), "text").select("task_index", F.lit("repeated").alias("reason"))
    return t, blank.unionByName(twice)


def episodes(meta: DataFrame, task_table: DataFrame, fps: float, excluded_kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes in order, violations) from metadata rows.

    ``meta``: episode_index, tasks array<string>, length, dataset_from_index, dataset_to_index, from_timestamp,
    to_timestamp. One task each, known in the table; bounds and duration must fit the length.
    """
    t = meta.withColumn("text", F.get("tasks", F.lit(0))).join(task_table, "text", "left")
    rules = {
        "one task": F.size("tasks") == 1,
        "known task": F.col("task_index").isNotNull(),
        "bounds": F.col("dataset_to_index") - F.col("dataset_from_index") == F.col("length"),
        "duration": F.abs(F.col("to_timestamp") - F.col("from_timestamp") - F.col("length") / fps) <= 1 / fps + 1e-3,
    }
    kept = t if excluded_kind is None else t.filter(~F.lower("text").contains(excluded_kind))
    return kept.orderBy("episode_index"), C.violations(t, "episode_index", rules)


def state_columns(frames: DataFrame, episode: int, dims: dict[str, int], state: str = "state") -> DataFrame:
    """Named dimensions (from 0) of one episode's states in order; the episode filter reaches the scan."""
    rows = frames.filter(F.col("episode_index") == episode)
    return rows.select("frame_index", *[F.get(state, F.lit(i)).alias(n) for n, i in dims.items()]).orderBy("frame_index")


RESULT_PATH = r"([^/]+)/([^/]+)/([^/]+)/(\d+)_[^/]*/([^/]+)/_?result\.json$"


def evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """Scores with what their path says: task/policy/embodiment/seed_.../timestamp/result.json.

    Spark's file listing skips names that begin with an underscore; publish such files under a name without it.
    """
    at = F.col("_metadata.file_path")
    raw = spark.read.text(path, wholetext=True).select(at.alias("p"), F.from_json("value", "details map<string,struct<score:double>>").alias("d"))
    part = lambda i: F.regexp_extract("p", RESULT_PATH, i)
    return raw.select(part(1).alias("task"), part(2).alias("policy"), part(3).alias("embodiment"), part(4).cast("long").alias("seed"), part(5).alias("timestamp"), F.explode("d.details").alias("layout_id", "s")).select(
        "task", "policy", "embodiment", "seed", "timestamp", F.col("layout_id").cast("long").alias("layout_id"), F.col("s.score").alias("score")
    )


def success_lines(spark: SparkSession, path: str) -> DataFrame:
    """(step, run, success) out of log lines ``... steps_N ... runM ... Average success: x``."""
    pattern = r"steps_(\d+).*run(\d+).*Average success: ([0-9.]+)"
    t = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return t.select(*[F.regexp_extract("value", pattern, i).cast(k).alias(n) for i, k, n in ((1, "long", "step"), (2, "long", "run"), (3, "double", "success"))])


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, content) of every ``meta/info.json`` below a root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").load(root)
    at = F.regexp_extract("path", r"^(.*)/meta/info\.json$", 1)
    return found.select(at.alias("dataset"), F.decode("content", "UTF-8").alias("content")).filter("dataset <> ''")


def discover_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole small files such as metadata documents."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.decode("content", "UTF-8").alias("content"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
