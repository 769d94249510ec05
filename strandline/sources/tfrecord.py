"""TFRecord files of examples as a Spark data source, read and written without another library.

A record is its length, a masked CRC-32C of the length, the bytes and a masked CRC-32C of the bytes. An example maps
names to lists of bytes, 32-bit floats or 64-bit integers. Columns become features of their name: integers and booleans
integers, floats and doubles 32-bit floats, strings and binaries bytes, arrays of them lists; a null is a missing
feature, an empty array an empty list.

``register(spark)`` makes ``spark.read.format("tfrecord").schema(...)`` and ``df.write.format("tfrecord")`` known for
paths that all nodes mount; ``read_files`` reads the same from any store that Spark reads.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.sources.storage import local

#: Bytes of one step of many checksums at once, and records of one batch.
STRIDE, RECORDS = 64, 2000
#: Bytes after which a task begins another file, so that readers of whole files hold a bounded number of bytes.
FILE_BYTES = 64 << 20
MASK = 0xA282EAD8


# --- CRC-32C (Castagnoli), many records at a time ------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


TABLE = _byte_table()
_TABLE = TABLE.tolist()


def _advance(columns: list[int], steps: int) -> list[int]:
    """A linear map of 32-bit states, told by the images of its bits, applied ``steps`` times (a power of two)."""
    while steps > 1:
        columns = [_apply(columns, c) for c in columns]
        steps //= 2
    return columns


def _apply(columns: list[int], state: int) -> int:
    out = 0
    for i in range(32):
        if state >> i & 1:
            out ^= columns[i]
    return out


_ONE = [int(TABLE[(1 << i) & 255]) ^ (1 << i) >> 8 for i in range(32)]  # a zero byte goes by
_POWERS = [_ONE]
while len(_POWERS) < 48:
    _POWERS.append(_advance(_POWERS[-1], 2))
#: Images of each byte of the state after ``STRIDE`` zero bytes.
_STRIDE_COLUMNS = _POWERS[STRIDE.bit_length() - 1]
_STRIDE_TABLES = [[_apply(_STRIDE_COLUMNS, b << 8 * k) for b in range(256)] for k in range(4)]
_begun: dict[int, int] = {}


def _after_zeros(n: int) -> int:
    """The initial state after n zero bytes."""
    if n not in _begun:
        state, k = 0xFFFFFFFF, 0
        while n >> k:
            if n >> k & 1:
                state = _apply(_POWERS[k], state)
            k += 1
        if len(_begun) > 100_000:
            _begun.clear()
        _begun[n] = state
    return _begun[n]


def checksums(records: list[bytes]) -> list[int]:
    """CRC-32C of each record. States are linear in the bytes: pieces are done side by side and joined."""
    padded = [-len(r) % STRIDE for r in records]
    rows = np.frombuffer(b"".join(b"\0" * p + r for p, r in zip(padded, records)), np.uint8).reshape(-1, STRIDE)
    state = np.zeros(len(rows), np.uint32)
    for j in range(STRIDE):
        state = TABLE[(state ^ rows[:, j]) & 255] ^ (state >> np.uint32(8))
    pieces, at, out = state.tolist(), 0, []
    t0, t1, t2, t3 = _STRIDE_TABLES
    for p, r in zip(padded, records):
        s = 0
        for x in pieces[at : at + (p + len(r)) // STRIDE]:
            s = t0[s & 255] ^ t1[s >> 8 & 255] ^ t2[s >> 16 & 255] ^ t3[s >> 24] ^ x
        at += (p + len(r)) // STRIDE
        out.append(s ^ _after_zeros(len(r)) ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


# --- examples ------------------------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


def encode(features: dict[str, tuple[str, list]]) -> bytes:
    """An example from name -> (bytes, float or int, values), in order of the names."""
    entries = []
    for name in sorted(features):
        kind, values = features[name]
        if kind == "bytes":
            feature = _field(1, b"".join(_field(1, v) for v in values))
        elif kind == "float":
            feature = _field(2, _field(1, np.array(values, "<f4").tobytes()) if len(values) else b"")
        else:
            feature = _field(3, _field(1, b"".join(map(_varint, values))) if len(values) else b"")
        entries.append(_field(1, _field(1, name.encode()) + _field(2, feature)))
    return _field(1, b"".join(entries))


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _number(data, at)
        else:
            size = 8 if wire == 1 else 4
            if wire == 2:
                size, at = _number(data, at)
            elif wire not in (1, 5):
                raise ValueError(f"wire type {wire} in an example")
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("an example ends early")
        yield tag >> 3, wire, value


def _values(feature: bytes) -> list:
    for number, _, body in _fields(feature):
        out: list = []
        for _, wire, v in _fields(body):
            if number == 1:
                out.append(v)
            elif number == 2:  # packed or one by one
                out += np.frombuffer(v, "<f4").tolist()
            elif wire == 0:
                out.append(v - (1 << 64) if v >> 63 else v)
            else:
                at = 0
                while at < len(v):
                    n, at = _number(v, at)
                    out.append(n - (1 << 64) if n >> 63 else n)
        return out
    return []


def decode(data: bytes, wanted: set[str]) -> dict[str, list]:
    """Name -> values of the wanted features of an example; of repeated names the last counts."""
    out = {}
    for number, _, features in _fields(data):
        for _, _, entry in _fields(features) if number == 1 else ():
            name, feature = "", b""
            for part, _, value in _fields(entry):
                if part == 1:
                    name = value.decode()
                else:
                    feature = value
            if name in wanted:
                out[name] = _values(feature)
    return out


# --- rows ----------------------------------------------------------------------------------------------------------


def _kind(t: T.DataType) -> tuple[str, bool]:
    """(kind of feature, whether a list) of a column."""
    many = isinstance(t, T.ArrayType)
    t = t.elementType if many else t
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "bytes", many
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float", many
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "int", many
    raise TypeError(f"no feature for a column of {t.simpleString()}")


def to_batch(examples: list[dict[str, list]], schema: T.StructType) -> pa.RecordBatch:
    """Examples as rows; a scalar column takes the first value."""
    target, columns = to_arrow_schema(schema), []
    for field, arrow in zip(schema.fields, target):
        kind, many = _kind(field.dataType)
        inner = field.dataType.elementType if many else field.dataType
        fix = (lambda v: v.decode()) if isinstance(inner, T.StringType) else bool if isinstance(inner, T.BooleanType) else (lambda v: v)
        found = [e.get(field.name) for e in examples]
        columns.append(pa.array([None if v is None or not (many or v) else [fix(x) for x in v] if many else fix(v[0]) for v in found], arrow.type))
    return pa.RecordBatch.from_arrays(columns, schema=target)


def from_batch(batch: pa.RecordBatch, schema: T.StructType) -> list[bytes]:
    """Rows as encoded examples."""
    columns = []
    for field, column in zip(schema.fields, batch.columns):
        kind, many = _kind(field.dataType)
        raw = (lambda v: v.encode() if isinstance(v, str) else bytes(v)) if kind == "bytes" else (lambda v: v)
        columns.append((field.name, kind, [None if v is None else [raw(x) for x in v] if many else [raw(v)] for v in column.to_pylist()]))
    return [encode({name: (kind, values[i]) for name, kind, values in columns if values[i] is not None}) for i in range(batch.num_rows)]


# --- files ---------------------------------------------------------------------------------------------------------


def framed(records: list[bytes]) -> bytes:
    heads = [struct.pack("<Q", len(r)) for r in records]
    return b"".join(h + struct.pack("<I", masked(a)) + r + struct.pack("<I", masked(b)) for h, r, a, b in zip(heads, records, checksums(heads), checksums(records)))


def _is_head(head: bytes) -> bool:
    if len(head) < 12:
        return False
    state = 0xFFFFFFFF
    for b in head[:8]:  # of one header faster than ``checksums``
        state = _TABLE[(state ^ b) & 255] ^ state >> 8
    return masked(state ^ 0xFFFFFFFF) == struct.unpack("<I", head[8:])[0]


def _first_record(stream, start: int, end: int, size: int) -> int:
    """The first record that begins in [start, end): a place whose header, and the one behind its record, hold."""
    if start == 0:
        return 0
    step = 1 << 14
    for base in range(start, min(end, size), step):
        stream.seek(base)
        data = stream.read(step + 11)
        n = min(step, end - base, len(data) - 11)
        if n <= 0:
            break
        heads = [data[i : i + 8] for i in range(n)]
        for i, crc in enumerate(checksums(heads)):
            if masked(crc) != struct.unpack_from("<I", data, i + 8)[0]:
                continue
            after = base + i + 16 + struct.unpack("<Q", heads[i])[0]
            if after == size:
                return base + i
            if after < size:
                stream.seek(after)
                if _is_head(stream.read(12)):
                    return base + i
    return end


def read_records(stream, name: str, start: int, end: int, size: int) -> Iterator[list[bytes]]:
    """Lists of records that begin in [start, end); a record that is damaged or cut short raises."""
    at = _first_record(stream, start, end, size)
    held, sums, held_bytes = [], [], 0

    def checked():
        for a, x in zip(sums, checksums(held)):
            if masked(x) != a:
                raise ValueError(f"{name} holds a damaged record")
        return held

    stream.seek(at)
    while at < min(end, size):
        head = stream.read(12)
        if not _is_head(head):
            raise ValueError(f"{name} holds a damaged record at byte {at}")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4) if at + 16 + n <= size else b""
        if len(body) < n + 4:
            raise ValueError(f"{name} is cut short at byte {at}")
        held.append(body[:n])
        sums.append(struct.unpack("<I", body[n:])[0])
        at, held_bytes = at + 16 + n, held_bytes + n
        if len(held) == RECORDS or held_bytes > 32 << 20:
            yield checked()
            held, sums, held_bytes = [], [], 0
    if held:
        yield checked()


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, local(options["path"])
        self.split = int(options.get("splitbytes", 0))
        for field in schema.fields:
            _kind(field.dataType)

    def partitions(self) -> list[Span]:
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.endswith((".tfrecord", ".tfrecords")))
        if not found and not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        out = []
        for p in found:
            size = os.path.getsize(p)
            step = self.split or max(size, 1)
            out += [Span(p, a, min(a + step, size), size) for a in range(0, size, step)]
        return out or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        wanted = set(self.schema.names)
        if span.size:
            with open(span.path, "rb") as stream:
                for records in read_records(stream, span.path, span.start, span.end, span.size):
                    yield to_batch([decode(r, wanted) for r in records], self.schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Tasks write files under names that readers skip; the commit renames those of the tasks that count."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path = schema, local(options["path"])
        for field in schema.fields:
            _kind(field.dataType)
        self.old = [n for n in os.listdir(self.path) if n.endswith(".tfrecord")] if overwrite and os.path.isdir(self.path) else []
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, out = [], None
        try:
            for batch in batches:
                if out is None or out.tell() >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    ident = uuid.uuid4().hex
                    done.append((os.path.join(self.path, f".part-{ident}.tmp"), os.path.join(self.path, f"part-{ident}.tfrecord")))
                    out = open(done[-1][0], "wb")
                out.write(framed(from_batch(batch, self.schema)))
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for beside, name in m.files:
                os.rename(beside, name)
        for n in self.old:
            os.remove(os.path.join(self.path, n))

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for beside, _ in m.files:
                if os.path.exists(beside):
                    os.remove(beside)


class TfRecords(DataSource):
    """Option ``path``: a file or a folder; ``splitBytes``: files are cut into parts of so many bytes, one a task. A part
    begins at the first place that two checksums of lengths vouch for, so do not cut files whose records hold TFRecords."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        raise ValueError("give the schema of the examples: spark.read.format('tfrecord').schema(...)")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TfRecords)


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Examples of whole files from any store that Spark reads; a file is one task's."""
    import io

    kind = spark.createDataFrame([], schema).schema
    wanted = set(kind.names)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for records in read_records(io.BytesIO(data), name, 0, len(data), len(data)):
                    yield to_batch([decode(r, wanted) for r in records], kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord*").load(path).select("path", "content").mapInArrow(run, kind)
