"""Content-addressed WARC archive.

An archive is a folder of two tables. ``payloads`` holds each payload once under its SHA-256 (``address``);
``headers`` holds the exact header bytes of every record, the address of its payload and whether the record carries
that payload as its body (a revisit does not). Original records come back by a join on the address, and every payload
read is checked against its address.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._shared import fresh_path, remove, scratch, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest whose hex length divides by five (SHA-1: 40)."""
    parts = []
    for k in range(8):
        n = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def payload_digest(payload: Column) -> Column:
    """The bare WARC payload digest: base32 of the SHA-1."""
    return base32_of_hex(F.sha1(payload))


def _same_bytes(payload: Column) -> Column:
    """One value for equal payloads, whatever their digest says."""
    return F.concat_ws(":", F.length(payload), F.crc32(payload), F.xxhash64(payload))


def save(records: DataFrame, path: str) -> None:
    """Write records (header binary, payload binary, has_body boolean) as an archive.

    Payloads with one digest but different bytes raise. Extra columns are kept beside the headers.
    """
    keyed = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("address", F.sha2("payload", 256))
    keyed.drop("payload").write.option("compression", "zstd").parquet(f"{path}/headers")
    save_payloads(keyed.select("address", "payload"), path)


def save_payloads(keyed: DataFrame, path: str) -> None:
    """Store (address, payload) once per address; equal payloads meet in each task before the shuffle."""
    once = keyed.groupBy("address").agg(
        F.any_value("payload").alias("payload"), F.min(_same_bytes(F.col("payload"))).alias("a"), F.max(_same_bytes(F.col("payload"))).alias("b")
    )
    checked = once.select("address", F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"))
    checked.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload) of an archive; a payload that does not match its address raises."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("address")
    return stored.select("address", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))).alias("payload"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive with ``record``, its exact original bytes."""
    joined = headers(spark, path).join(payloads(spark, path), "address")
    body = F.when(F.col("has_body"), F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", body, F.lit(END)))


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, address, has_body, header) of one WARC record per page; payload: the html in UTF-8 (null: empty).

    Of equal payloads of at least ``min_bytes`` bytes the page with the least id is the response and the others are
    revisits that refer to it; smaller payloads are responses all. Rows that repeat both id and payload are the same
    record written twice, so responses both. A null id is never the least; where no other has the payload, all of its
    records are responses. A null url is written as empty, an empty html is a payload of no bytes. A payload of any
    length is one value of a row. An empty table gives an empty result; other columns are not read, so their names can't
    clash. Payload bytes are not shuffled.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    index = written(
        pages.select(
            F.col(id_col).alias("page_id"),
            F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("url"),
            F.sha2(payload, 256).alias("address"),
            payload_digest(payload).alias("digest"),
            F.length(payload).cast("long").alias("n"),
        ),
        "warc-index",
    )
    least = written(index.groupBy("address").agg(F.min("page_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1"), "warc-least")
    joined = index.join(least, "address", "left")
    again = (F.col("n") >= min_bytes) & F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("least")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )
    return joined.select("page_id", "address", (~again).alias("has_body"), F.encode(header, "UTF-8").alias("header"))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one WARC record per page into the archive at ``path``."""
    with scratch(pages.sparkSession):
        page_records(pages, min_bytes).drop("page_id").write.option("compression", "zstd").parquet(f"{path}/headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    save_payloads(pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload")), path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What an archive of pages says of each record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Every record is rebuilt by the join of header and payload and everything is parsed out of its bytes; the payload of a
    revisit is that under its address. Lengths and digests of header and payload must agree, or it raises. An id that is
    no integer is null.
    """
    # one character for each byte, so that places in the text are places in the record
    found = rebuild(spark, path).select("record", "payload", F.decode("record", "ISO-8859-1").alias("text"))
    found = found.withColumn("head", F.expr(r"locate('\r\n\r\n', text)")).withColumn("body", F.expr(r"locate('\r\n\r\n', text, head + 4) + 4"))
    found = found.withColumn("warc", F.substring("text", F.lit(1), F.col("head") + 1)).drop("text")

    def field(name: str) -> Column:
        value = F.regexp_extract("warc", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    def number(of: Column) -> Column:
        digits = F.regexp_extract(F.coalesce(of, F.lit("")), r"^<urn:page:(-?\d{1,19})>$", 1)
        return F.when(digits != "", digits).cast("long")

    block = field("Content-Length").cast("int")
    end = F.col("head") + 4 + block
    stored = F.substring("record", F.col("body"), end - F.col("body"))
    parsed = found.select(
        number(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Payload-Digest").alias("said"),
        (F.length("record") == end + 3).alias("whole"),
        F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(stored).alias("payload"),
    )
    facts = parsed.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload")))
    good = F.col("whole") & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("said"))
    digest = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return facts.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def parse_records(data: bytes):
    """(header, payload) of each record of an uncompressed WARC; HTTP headers belong to the header bytes."""
    at = 0
    while at < len(data):
        head = data.index(END, at) + len(END)
        fields = dict(line.split(b": ", 1) for line in data[at : head - len(END)].split(b"\r\n")[1:] if b": " in line)
        length = int({k.lower(): v for k, v in fields.items()}[b"content-length"])
        block = data[head : head + length]
        cut = block.find(END) + len(END) if block.startswith(b"HTTP/") and END in block else 0
        yield data[at:head] + block[:cut], block[cut:]
        at = head + length + len(END)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, has_body) of all records of WARC files, plain or gzipped (one member or one for each record).

    One task reads a whole file, so files have to be of the usual size (about a gigabyte, 2 GB at most).
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                found = list(parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.binary()), pa.array([p for _, p in found], pa.binary()), pa.array([bool(p) for _, p in found])],
                    ["header", "payload", "has_body"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary, has_body boolean")


def op1(spark, root):
    """Query op1_warc: archive the pages, read the archive back; the archive goes once its records are told."""
    path = fresh_path(spark, "warc")
    with scratch(spark) as keep:
        archive_pages(spark.read.parquet(f"{root}/pages.parquet"), path)
        records = keep(read_pages(spark, path), "warc-records")
        remove(spark, [path])
        return records


SQL = """
WITH stored AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), first_of AS (
  SELECT payload AS same, min(page_id) AS least FROM stored GROUP BY 1
), spelled AS (
  SELECT page_id, payload, array_to_string(list_transform(range(32), lambda i:
           substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     ((CAST('0x' || substring(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest
  FROM stored
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM spelled JOIN first_of ON payload = same
"""
