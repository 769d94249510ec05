"""TFRecord files: checksums, wire format, round trips, damage and cut files."""

import io
import os
import random
import struct

import pyarrow as pa
import pytest

from strandline.sources import tfrecord as R


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert R.checksums([b"123456789", b"", b"\0" * 32]) == [0xE3069283, 0, 0x8A9136AA]
    rng = random.Random(1)
    records = [rng.randbytes(rng.choice((0, 1, 63, 64, 65, 500, 4000))) for _ in range(40)]
    assert R.checksums(records) == [slow_crc(r) for r in records]


def test_an_example_as_other_writers_make_it():
    # features { feature { key: "a" value { int64_list { value: [1, -1] } } } feature { key: "f" value { float_list { value: 1.5 } } } }
    packed = bytes.fromhex("0a23" "0a14" "0a0161" "120f" "1a0d" "0a0b" "01" "ffffffffffffffffff01") + bytes.fromhex("0a0d" "0a0166" "1208" "1206" "0a04" "0000c03f")
    data = bytes([0x0A, len(packed) - 2]) + packed[2:]
    assert R.decode(data, {"a", "f"}) == {"a": [1, -1], "f": [1.5]}
    assert R.encode({"f": ("float", [1.5]), "a": ("int", [1, -1])}) == data
    unpacked = R._field(1, R._field(1, R._field(1, b"a") + R._field(2, R._field(3, b"\x08\x05\x08\x07"))))
    assert R.decode(unpacked, {"a"}) == {"a": [5, 7]} and R.decode(unpacked, {"b"}) == {}


ROWS = [
    (1, True, 0.5, "naïve", b"\x00\xff", [1, -5, 2**62], [0.25, -1.0], ["a", "", "ß"]),
    (-(2**63), False, -3.0, "", b"", [], [], []),
    (None, None, None, None, None, None, None, None),
]
KIND = "i long, b boolean, f double, s string, raw binary, ints array<long>, floats array<float>, texts array<string>"


def key(rows):
    return sorted((str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in rows))


def test_round_trip_of_all_kinds(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "t")
    df = spark.createDataFrame(ROWS, KIND)
    df.repartition(2).write.format("tfrecord").mode("append").save(path)
    assert key(spark.read.format("tfrecord").schema(KIND).load(path).collect()) == key(ROWS)
    assert key(R.read_files(spark, path, KIND).collect()) == key(ROWS)
    df.limit(1).write.format("tfrecord").mode("overwrite").save(path)
    assert spark.read.format("tfrecord").schema("i long, missing string").load(path).collect() == [(1, None)]
    assert not [n for n in os.listdir(path) if n.startswith(".")]
    with pytest.raises(Exception, match="no feature"):
        spark.range(1).selectExpr("current_date() AS d").write.format("tfrecord").mode("append").save(path)


def test_parts_of_a_file_give_each_record_once():
    rng = random.Random(4)
    records = [rng.randbytes(rng.choice((0, 3, 50, 900, 40_000))) for _ in range(120)]
    data = R.framed(records)
    for step in (37, 1000, 65_536):
        got = []
        for a in range(0, len(data), step):
            for part in R.read_records(io.BytesIO(data), "x", a, min(a + step, len(data)), len(data)):
                got += part
        assert got == records


def test_split_files_are_many_tasks(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "big")
    spark.range(3000).selectExpr("id AS i", "cast(id AS string) AS s").coalesce(1).write.format("tfrecord").mode("append").save(path)
    df = spark.read.format("tfrecord").schema("i long, s string").option("splitBytes", 20_000).load(path)
    assert df.rdd.getNumPartitions() > 4
    assert sorted(r.i for r in df.collect()) == list(range(3000))


@pytest.mark.parametrize("where", ["length", "bytes", "end"])
def test_damage_raises(spark, tmp_path, where):
    R.register(spark)
    data = bytearray(R.framed([R.encode({"i": ("int", [7])})] * 3))
    n = struct.unpack_from("<Q", data)[0] + 16
    if where == "end":
        data = data[:-3]
    else:
        data[n + (0 if where == "length" else 14)] ^= 1
    path = tmp_path / "d.tfrecord"
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|cut short"):
        spark.read.format("tfrecord").schema("i long").load(str(path)).collect()


def test_records_are_checked_together(monkeypatch):
    """A pass over arrays for each header took fifty times as long as the rest of reading."""
    calls, sums = [], R.checksums
    data = R.framed([b"abc"] * 5000)
    monkeypatch.setattr(R, "checksums", lambda records: calls.append(len(records)) or sums(records))
    assert sum(map(len, R.read_records(io.BytesIO(data), "x", 0, len(data), len(data)))) == 5000
    assert len(calls) < 20


def test_tasks_write_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FILE_BYTES", 5000)
    path = str(tmp_path / "t")
    kind = spark.range(0).schema
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100))], ["id"]) for i in range(0, 3000, 100)]
    writer = R.Writer(kind, {"path": path}, False)
    writer.commit([writer.write(iter(batches)), writer.write(iter([])), None])
    sizes = [os.path.getsize(os.path.join(path, n)) for n in os.listdir(path)]
    assert len(sizes) > 5 and max(sizes) < 10_000
    assert sorted(r.id for r in R.read_files(spark, path, "id long").collect()) == list(range(3000))
