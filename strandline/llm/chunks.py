"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text; a chunk ends where the hash is the least within ``reach`` bytes on either side
(leftmost of equals) and after ``longest`` bytes at the latest. The hash sees the last 32 bytes only and the rule looks
no farther than ``reach``, so an insertion moves the cuts next to it and no others, and two copies of a passage cut
alike from their first bytes on (a threshold on the hash with a least chunk size falls into step later).
Chunks meet by a 128-bit digest of their bytes; the earliest (document, start) keeps its bytes and all others go. With
``min_run`` set, runs of repeated chunks under so many bytes stay.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import bucket_count, by_bucket, row_chunks, split_blobs, text_bytes, utf8, written
from strandline.llm.suffix import BLOBS, SPAN, SPANS, _blob_batch, _merge_spans, _read_blobs, _records, _spans_of, _table, cut_out, digests, keyed, span_batches, union_of_spans

GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 32, 256, dtype=np.uint32)
PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("n", "<u4")])
FLUSH = 500_000


@dataclass(frozen=True)
class Cuts:
    """Chunks have more than ``reach`` bytes (but at a text's ends), 2 * reach + 1 on average; runs of repeats under
    ``min_run`` bytes stay (0: none)."""

    reach: int = 48
    longest: int = 512
    min_run: int = 0


def _earliest(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True where no row with the same key (a, b) has a lesser (doc, pos)."""
    order = np.lexsort((pos, doc, b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), bool)
    out[order] = first
    return out


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: h = (h << 1) + GEAR[byte], which forgets all but the last 32 bytes."""
    h = GEAR[data]
    n = 1
    while n < 32:
        more = h.copy()
        more[n:] += h[:-n] << np.uint32(n)
        h, n = more, 2 * n
    return h


def chunk_ends(ends: list[int], length: int, cuts: Cuts) -> list[int]:
    """Ends of the chunks of one text, from the rising places (relative to it) that the hash offers as ends."""
    out, at = [], 0
    for e in [*ends, length]:
        while e - at > cuts.longest:
            at += cuts.longest
            out.append(at)
        if e > at:
            out.append(e)
            at = e
    return out


def text_chunks(data: np.ndarray, offs: np.ndarray, cuts: Cuts) -> list[list[int]]:
    """Chunk ends of each text. The hash runs over text borders, so a cut needs ``reach`` + 32 bytes of its own text
    before it and ``reach`` behind it."""
    key = (gear_hashes(data).astype(np.uint64) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    width, n = 2 * cuts.reach + 1, 1
    least = key if len(key) >= width else key[:0]
    while 2 * n <= width and len(least):
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width and len(least):
        least = np.minimum(least[: n - width], least[width - n :])
    places = np.flatnonzero(least == key[cuts.reach : cuts.reach + len(least)]) + cuts.reach + 1
    doc = np.searchsorted(offs, places, "left") - 1
    local = places - offs[doc]
    good = (local >= cuts.reach + 32) & (local + cuts.reach <= offs[doc + 1] - offs[doc])
    local, doc = local[good], doc[good]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    local, lengths = local.tolist(), np.diff(offs).tolist()
    return [chunk_ends(local[bounds[i] : bounds[i + 1]], n, cuts) for i, n in enumerate(lengths)]


def _chunk(n_buckets: int, cuts: Cuts):
    """(key, text) -> blobs by digest: 1 the first place of each chunk in this task, 2 its later places."""

    def flush(parts):
        p = _table(parts, PLACE)
        first = _earliest(p["a"], p["b"], p["doc"], p["pos"])
        k = p[~first]
        s = _merge_spans(_spans_of(k["doc"], k["pos"], k["pos"] + k["n"]))
        rows = [(b, 1, blob) for b, blob in split_blobs((p["a"][first] % np.uint64(n_buckets)).astype(np.int64), p[first])]
        rows += [(b, 2, blob) for b, blob in split_blobs(s["doc"] % n_buckets, s)]
        if rows:
            yield _blob_batch(rows)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            all_data, all_offs = utf8(batch.column(1))
            for r0, r1 in row_chunks(all_offs, 1 << 19):
                offs = all_offs[r0 : r1 + 1] - all_offs[r0]
                data = all_data[all_offs[r0] : all_offs[r1]]
                raw = data.tobytes()
                found, digest = [], []
                for i, ends in enumerate(text_chunks(data, offs, cuts)):
                    base, at = int(offs[i]), 0
                    for e in ends:
                        digest.append(hashlib.blake2b(raw[base + at : base + e], digest_size=16).digest())
                        found.append((r0 + i, at, e - at))
                        at = e
                if not found:
                    continue
                found = np.array(found, np.int64)
                keys = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
                p = np.empty(len(found), PLACE)
                p["a"], p["b"], p["doc"], p["pos"], p["n"] = keys[:, 0], keys[:, 1], ids[found[:, 0]], found[:, 1], found[:, 2]
                parts.append(p)
                held += len(p)
            if held >= FLUSH:
                yield from flush(parts)
                parts, held = [], 0
        yield from flush(parts)

    return run


def _later_places(batches):
    """Spans of chunks that have an earlier place; touching spans of a document become one."""
    held = _read_blobs(batches)
    p = _records(held, 1, PLACE)
    k = p[~_earliest(p["a"], p["b"], p["doc"], p["pos"])]
    s = _spans_of(k["doc"], k["pos"], k["pos"] + k["n"])
    yield from span_batches(_merge_spans(np.concatenate([s, _records(held, 2, SPAN)])))


def _long_runs(min_run: int):
    """Spans of each document, merged, without runs under ``min_run`` bytes."""
    def run(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in union_of_spans((s["start"], s["end"]) for s in spans):
                    if b - a >= min_run:
                        ids.append(doc)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc", "start", "end"])

    return run


def repeated_chunks(rows: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Spans (doc, start, end) of repeated chunks in runs of ``min_run`` bytes or more, for (doc, text), ``doc`` a key as
    of ``with_key`` that is there once."""
    n = bucket_count(text_bytes(rows))
    spans = by_bucket(rows.mapInArrow(_chunk(n, cuts), BLOBS), n).mapInArrow(_later_places, SPANS)
    if cuts.min_run:
        spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(_long_runs(cuts.min_run), SPANS)
    return written(spans, "chunk-spans")


def dedup(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc, n_bytes, kept, spans) of the changed documents, (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all rows).

    The earliest place of a chunk is the one in the first document, there the least start. Documents come in order of id
    (a null id first). Rows that repeat an id with another text are documents of their own, in order of their texts'
    digests; rows that agree in id and text are one document and get a result each. Null texts are empty and have no
    chunk. A text of any length is one row of a task and is cut in one piece. Empty tables give empty results; other
    columns are not read, so their names can't clash.
    """
    rows, once = keyed(docs, id_col, text_col)
    spans = repeated_chunks(once, cuts)
    return cut_out(once, spans), digests(rows, spans, once)


def op6(spark, root):
    """Query op6_chunk_dedup: bytes, removed bytes and spans, and the digest of what is left, of each document."""
    return dedup(spark.read.parquet(f"{root}/documents.parquet"))[1]
