import base64
import gzip
import hashlib

import duckdb
import pandas as pd
import pytest

from strandline.llm import warc

ROWS = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, "<p>é</p>"), (4, "x", None), (5, "y", ""), (6, "z", "WARC/1.1\r\n\r\nHTTP/\r\n\r\n" * 3), (7, "z", "long " * 5000)]


def want(rows, least):
    first = {}
    for i, _, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    for i, _, t in rows:
        data = (t or "").encode()
        again = first[t or ""] != i and len(data) >= least
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else None


@pytest.mark.parametrize("least", [0, 5])
def test_pages_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "page_id long, url string, html string, address int, header string")
    warc.archive_pages(pages, str(tmp_path / "a"), least)
    got = sorted(tuple(r) for r in warc.read_pages(spark, str(tmp_path / "a")).collect())
    assert got == sorted(want(ROWS, least), key=lambda r: r[0])
    assert warc.payloads(spark, str(tmp_path / "a")).count() == 4
    if least == 0:
        pages = pd.DataFrame(ROWS, columns=["page_id", "url", "html"])  # noqa: F841
        assert sorted(duckdb.connect().execute(warc.SQL).fetchall()) == got


def test_records_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path / "a"))
    original = [bytes(r.record) for r in warc.rebuild(spark, str(tmp_path / "a")).collect()]
    forms = {"x.warc": b"".join(original), "y.warc.gz": b"".join(map(gzip.compress, original)), "z.warc.gz": gzip.compress(b"".join(original))}
    for name, data in forms.items():
        (tmp_path / name).write_bytes(data)
        warc.save(warc.read_warc_files(spark, str(tmp_path / name)), str(tmp_path / f"{name}-saved"))
        assert sorted(bytes(r.record) for r in warc.rebuild(spark, str(tmp_path / f"{name}-saved")).collect()) == sorted(original)


def test_damage_is_seen(spark, tmp_path):
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "address string, payload binary").write.parquet(str(tmp_path / "payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.payloads(spark, str(tmp_path)).collect()


def test_a_header_of_another_payload_is_seen(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string"), str(tmp_path / "a"))
    rows = spark.read.parquet(str(tmp_path / "a" / "headers")).collect()
    swapped = [(rows[0].address, True, rows[1].header), (rows[1].address, True, rows[0].header)]
    spark.createDataFrame(swapped, "address string, has_body boolean, header binary").write.parquet(str(tmp_path / "b" / "headers"))
    (tmp_path / "a" / "payloads").rename(tmp_path / "b" / "payloads")
    with pytest.raises(Exception, match="header and payload differ"):
        warc.read_pages(spark, str(tmp_path / "b")).collect()


def test_the_query(spark, tmp_path):
    rows = [*ROWS, (8, "long", "<p>" + "é" * 700_000), (9, "nul", "a\x00b\r\n\r\nc")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = warc.op1(spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect())) == sorted(want(rows, 0), key=lambda r: r[0])


def test_empty_and_repeated(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive_pages(empty, str(tmp_path / "e"))
    assert warc.read_pages(spark, str(tmp_path / "e")).count() == 0
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    warc.archive_pages(twice, str(tmp_path / "t"))
    assert sorted((r.record_type, r.refers_to) for r in warc.read_pages(spark, str(tmp_path / "t")).collect()) == [("response", None), ("response", None), ("revisit", 1)]
