"""MCAP containers of timed messages as a Spark data source that plans its tasks from each file's chunk index.

A file is a row of records (an opcode, a length, a body) between two magic strings. Messages are in chunks; the summary
behind them has the schemas, the channels and, for each chunk, its place, its time range and its channels. The planner
reads footers and summaries alone, and drops chunks that filters on ``log_time`` and ``topic`` rule out. Bodies stay
binary: decoding them is a matter of the messages' own encoding.

``register(spark)`` makes ``spark.read.format("mcap")`` and ``df.write.format("mcap")`` known, for paths that all nodes
mount. Filters reach the source if ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from strandline.sources.storage import local

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, INDEX, CHUNK_INDEX, STATISTICS, DATA_END = 1, 2, 3, 4, 5, 6, 7, 8, 11, 15
COLUMNS = "topic string, log_time long, publish_time long, sequence long, encoding string, schema string, data binary"
#: Rows of a batch, and uncompressed bytes of a chunk that the writer makes.
ROWS, CHUNK_BYTES = 5000, 1 << 20


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


class Body:
    """Fields of a record's body, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, kind: str) -> int:
        (n,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += struct.calcsize("<" + kind)
        return n

    def bytes(self, kind: str = "I") -> bytes:
        n = self.number(kind)
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a record ends early")
        self.at += n
        return out

    def text(self) -> str:
        return self.bytes().decode()

    def rest(self) -> bytes:
        return self.data[self.at :]


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        op, n = struct.unpack_from("<BQ", data, at)
        if at + 9 + n > len(data):
            raise ValueError("a record ends early")
        yield op, data[at + 9 : at + 9 + n]
        at += 9 + n


@dataclass(frozen=True)
class ChunkInfo:
    first: int
    last: int
    start: int
    length: int
    channels: tuple[int, ...]


def summary(path: str) -> tuple[dict[int, tuple[str, str, str]], list[ChunkInfo]]:
    """(channel -> (topic, encoding, schema's name), chunks) out of the end of a file."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        tail = 9 + 20 + len(MAGIC)
        if size < tail + len(MAGIC) or file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        file.seek(size - tail)
        end = file.read(tail)
        if end[-len(MAGIC) :] != MAGIC or end[0] != FOOTER:
            raise ValueError(f"{path} has no footer: it was not closed")
        start = struct.unpack_from("<Q", end, 9)[0]
        file.seek(start)
        found = file.read(size - tail - start) if start else b""
    schemas, channels, chunks = {0: ""}, {}, []
    for op, data in records(found):
        body = Body(data)
        if op == SCHEMA:
            ident = body.number("H")
            schemas[ident] = body.text()
        elif op == CHANNEL:
            ident, schema = body.number("H"), body.number("H")
            channels[ident] = body.text(), body.text(), schema
        elif op == CHUNK_INDEX:
            first, last, at, length = (body.number("Q") for _ in range(4))
            offsets = Body(body.bytes())
            ids = []
            while offsets.at < len(offsets.data):
                ids.append(offsets.number("H"))
                offsets.number("Q")
            chunks.append(ChunkInfo(first, last, at, length, tuple(ids)))
    if not chunks and (not start or any(op == STATISTICS and struct.unpack_from("<Q", d)[0] for op, d in records(found))):
        raise ValueError(f"{path} has no chunk index")
    return {i: (topic, encoding, schemas.get(s, "")) for i, (topic, encoding, s) in channels.items()}, chunks


def chunk_messages(path: str, chunk: ChunkInfo) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(channel, log time, publish time, sequence, data) of a chunk; one that is damaged raises."""
    with open(path, "rb") as file:
        file.seek(chunk.start)
        data = file.read(chunk.length)
    if len(data) < chunk.length or data[0] != CHUNK:
        raise ValueError(f"{path} has no chunk at byte {chunk.start}")
    body = Body(data[9:])
    body.number("Q"), body.number("Q")
    size, crc, compression = body.number("Q"), body.number("I"), body.text()
    packed = body.bytes("Q")
    if compression not in ("", "zstd"):
        raise ValueError(f"{path} is compressed by {compression}, for which there is no library here")
    plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size) if compression else packed
    if len(plain) != size or crc and zlib.crc32(plain) != crc:
        raise ValueError(f"{path} holds a damaged chunk at byte {chunk.start}")
    for op, record in records(plain):
        if op == MESSAGE:
            m = Body(record)
            channel, sequence, log_time, publish_time = m.number("H"), m.number("I"), m.number("Q"), m.number("Q")
            yield channel, log_time, publish_time, sequence, m.rest()


@dataclass
class Part(InputPartition):
    path: str
    channels: dict[int, tuple[str, str, str]]
    chunks: list[ChunkInfo]


class Reader(DataSourceReader):
    """Chunks by file; ``chunksPerTask`` (8) of them in a row are one task."""

    def __init__(self, options: dict):
        self.path, self.per_task = local(options["path"]), int(options.get("chunkspertask", 8))
        self.low, self.high, self.topics = 0, (1 << 63) - 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name == ("log_time",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == ("log_time",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            if name == ("topic",) and isinstance(f, (EqualTo, In)):
                these = {value} if isinstance(f, EqualTo) else set(value)
                self.topics = these if self.topics is None else self.topics & these
            yield f  # chunks are dropped, rows are left to Spark

    def planned(self) -> list[Part]:
        """The chunks that may hold rows."""
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.endswith(".mcap"))
        if not found and not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        out = []
        for path in found:
            channels, chunks = summary(path)
            ids = {i for i, c in channels.items() if self.topics is None or c[0] in self.topics}
            met = [c for c in chunks if c.last >= self.low and c.first <= self.high and ids & set(c.channels)]
            if met:
                out.append(Part(path, channels, met))
        return out

    def partitions(self) -> list[Part]:
        n = self.per_task
        parts = [Part(p.path, p.channels, p.chunks[i : i + n]) for p in self.planned() for i in range(0, len(p.chunks), n)]
        return parts or [Part("", {}, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for chunk in part.chunks:
            for channel, log_time, publish_time, sequence, data in chunk_messages(part.path, chunk):
                topic, encoding, schema = part.channels[channel]
                held.append((topic, log_time, publish_time, sequence, encoding, schema, data))
                if len(held) == ROWS:
                    yield _rows(held)
                    held = []
        if held:
            yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [c.split()[0] for c in COLUMNS.split(", ")])


class FileWriter:
    """One file, chunk after chunk; what the summary needs is remembered: topics and a row for each chunk."""

    def __init__(self, out, compression: str = "zstd", chunk_bytes: int = CHUNK_BYTES):
        self.out, self.compression, self.chunk_bytes = out, compression, chunk_bytes
        self.schemas: dict[str, int] = {}
        self.channels: dict[tuple[str, str, str], int] = {}
        self.counts: dict[int, int] = defaultdict(int)
        self.indexes: list[bytes] = []
        self.first, self.last = None, 0
        self.at = 0
        self._put(MAGIC + _record(HEADER, _text("") + _text("strandline")))
        self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _open(self) -> None:
        self.chunk, self.size, self.places, self.times = [], 0, defaultdict(list), []

    def _add(self, data: bytes) -> None:
        self.chunk.append(data)
        self.size += len(data)

    def _schema_record(self, name: str) -> bytes:
        return _record(SCHEMA, struct.pack("<H", self.schemas[name]) + _text(name) + _text("") + struct.pack("<I", 0))

    def _channel_record(self, key: tuple[str, str, str]) -> bytes:
        topic, encoding, schema = key
        return _record(CHANNEL, struct.pack("<HH", self.channels[key], self.schemas.get(schema, 0)) + _text(topic) + _text(encoding) + struct.pack("<I", 0))

    def message(self, topic: str, log_time: int, publish_time: int, sequence: int, encoding: str, schema: str, data: bytes) -> None:
        if schema and schema not in self.schemas:
            self.schemas[schema] = len(self.schemas) + 1
            self._add(self._schema_record(schema))
        key = topic, encoding, schema
        if key not in self.channels:
            self.channels[key] = len(self.channels)
            self._add(self._channel_record(key))
        channel = self.channels[key]
        self.places[channel].append((log_time, self.size))
        self.times.append(log_time)
        self.counts[channel] += 1
        self._add(_record(MESSAGE, struct.pack("<HIQQ", channel, sequence & 0xFFFFFFFF, log_time, publish_time) + data))
        if self.size >= self.chunk_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.times:
            return
        plain = b"".join(self.chunk)
        packed = zstandard.ZstdCompressor().compress(plain) if self.compression else plain
        first, last, start = min(self.times), max(self.times), self.at
        head = struct.pack("<QQQI", first, last, len(plain), zlib.crc32(plain)) + _text(self.compression)
        self._put(_record(CHUNK, head + struct.pack("<Q", len(packed)) + packed))
        length, offsets, before = self.at - start, b"", self.at
        for channel in sorted(self.places):
            offsets += struct.pack("<HQ", channel, self.at)
            entries = b"".join(struct.pack("<QQ", t, p) for t, p in self.places[channel])
            self._put(_record(INDEX, struct.pack("<HI", channel, len(entries)) + entries))
        index = struct.pack("<QQQQI", first, last, start, length, len(offsets)) + offsets
        index += struct.pack("<Q", self.at - before) + _text(self.compression) + struct.pack("<QQ", len(packed), len(plain))
        self.indexes.append(_record(CHUNK_INDEX, index))
        self.first, self.last = first if self.first is None else min(self.first, first), max(self.last, last)
        self._open()

    def close(self) -> None:
        self._flush()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = self.at
        counts = b"".join(struct.pack("<HQ", c, n) for c, n in sorted(self.counts.items()))
        stats = struct.pack("<QHIIIIQQI", sum(self.counts.values()), len(self.schemas), len(self.channels), 0, 0, len(self.indexes), self.first or 0, self.last, len(counts)) + counts
        self._put(b"".join([*map(self._schema_record, self.schemas), *map(self._channel_record, self.channels), *self.indexes, _record(STATISTICS, stats)]))
        self._put(_record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC)


@dataclass
class Written(WriterCommitMessage):
    beside: str
    name: str


class Writer(DataSourceArrowWriter):
    """A file for each task, in order of its rows; options ``compression`` (zstd or none) and ``chunkBytes``."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = local(options["path"])
        self.compression, self.chunk_bytes = {"none": ""}.get(options.get("compression", "zstd"), "zstd"), int(options.get("chunkbytes", CHUNK_BYTES))
        self.old = [n for n in os.listdir(self.path) if n.endswith(".mcap")] if overwrite and os.path.isdir(self.path) else []
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written | None:
        ident = uuid.uuid4().hex
        beside = os.path.join(self.path, f".part-{ident}.tmp")
        with open(beside, "wb") as out:
            file = FileWriter(out, self.compression, self.chunk_bytes)
            for batch in batches:
                named = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for row in zip(*(named[c.split()[0]] for c in COLUMNS.split(", "))):
                    file.message(*(x if x is not None else d for x, d in zip(row, ("", 0, 0, 0, "", "", b""))))
            file.close()
        return Written(beside, os.path.join(self.path, f"part-{ident}.mcap"))

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            os.rename(m.beside, m.name)
        for n in self.old:
            os.remove(os.path.join(self.path, n))

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            if os.path.exists(m.beside):
                os.remove(m.beside)


class Mcap(DataSource):
    """Columns: see ``COLUMNS``. Times are nanoseconds; nulls are written as empty strings and zeros."""

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if set(schema.names) != {c.split()[0] for c in COLUMNS.split(", ")}:
            raise ValueError(f"columns are {COLUMNS}")
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mcap)
