"""MCAP files: round trip, pruning by the chunk index, damage."""

import io
import os
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from strandline.sources import mcap as M


@pytest.fixture(scope="module")
def messages():
    rng = random.Random(3)
    return [(f"/arm/{i // 400}" if i % 3 else "/camera", 1000 * i, 1000 * i + 5, i, "cdr", "" if i % 3 else "Image", rng.randbytes(rng.choice((0, 8, 700)))) for i in range(2000)]


@pytest.fixture(scope="module", params=["zstd", "none"])
def folder(spark, messages, tmp_path_factory, request):
    M.register(spark)
    path = str(tmp_path_factory.mktemp("mcap") / "t")
    df = spark.createDataFrame(messages, M.COLUMNS).repartitionByRange(2, "log_time").sortWithinPartitions("log_time")
    df.write.format("mcap").option("chunkBytes", 20_000).option("compression", request.param).mode("append").save(path)
    return path


def plain(rows):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)


def test_round_trip(spark, folder, messages):
    df = spark.read.format("mcap").load(folder)
    assert plain(df.collect()) == sorted(messages)
    assert df.rdd.getNumPartitions() > 2


def chunks(folder, *filters):
    reader = M.Reader({"path": folder})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return sum(len(p.chunks) for p in reader.planned())


def test_filters_drop_chunks(spark, folder, messages):
    whole = chunks(folder)
    late = chunks(folder, GreaterThanOrEqual(("log_time",), 1_800_000))
    assert whole > 20 and 0 < late < whole / 5
    assert 0 < chunks(folder, EqualTo(("topic",), "/arm/0")) < whole / 3
    assert chunks(folder, In(("topic",), ("/none",))) == 0 and chunks(folder, LessThan(("log_time",), 0)) == 0
    df = spark.read.format("mcap").load(folder).filter("log_time >= 1800000 AND topic = '/camera' AND log_time < 1900000")
    assert plain(df.collect()) == sorted(m for m in messages if 1_800_000 <= m[1] < 1_900_000 and m[0] == "/camera")


def test_many_files_and_empty_ones(spark, messages, tmp_path):
    M.register(spark)
    path = str(tmp_path / "t")
    spark.createDataFrame(messages[:5], M.COLUMNS).repartition(8).write.format("mcap").mode("append").save(path)
    assert plain(spark.read.format("mcap").load(path).collect()) == sorted(messages[:5])
    spark.createDataFrame(messages[5:6], M.COLUMNS).write.format("mcap").mode("overwrite").save(path)
    assert plain(spark.read.format("mcap").load(path).collect()) == messages[5:6]
    spark.createDataFrame([], M.COLUMNS).write.format("mcap").mode("append").save(str(tmp_path / "e"))
    assert spark.read.format("mcap").load(str(tmp_path / "e")).collect() == []


def test_damage_raises(tmp_path):
    out = io.BytesIO()
    file = M.FileWriter(out, "", 100)
    for i in range(20):
        file.message("/a", i, i, i, "", "", b"x" * 50)
    file.close()
    data = bytearray(out.getvalue())
    path = str(tmp_path / "d.mcap")

    def read(content):
        with open(path, "wb") as f:
            f.write(content)
        channels, found = M.summary(path)
        return [m for c in found for m in M.chunk_messages(path, c)]

    assert len(read(data)) == 20
    at = data.index(b"x" * 50)
    with pytest.raises(ValueError, match="damaged"):
        read(data[:at] + b"y" + data[at + 1 :])
    with pytest.raises(ValueError, match="footer"):
        read(data[:-30])
    with pytest.raises(ValueError, match="no MCAP"):
        read(b"PK" + data[2:])
    assert os.path.getsize(path) > 0
