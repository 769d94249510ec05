"""Exact removal of repeated 100-byte strings through a sparse, range-partitioned suffix array.

Only some suffixes are sorted. Of every ``LENGTH``-byte window the ``GRAM``-byte string with the least hash (leftmost
of equals) is its *anchor*. The choice looks at nothing but the window's bytes, so equal windows have their anchor at
the same offset: two windows are equal exactly if their anchors' suffixes and the few bytes before them agree.

1. Anchors of all documents meet by hash in buckets; only those whose gram occurs twice or more go on (*candidates*).
2. A bounded sample of candidate suffixes gives splitters, which range-partition all of them by their leading bytes; of
   equal contexts in one task, only the earliest travels. Suffixes that agree in all of their bytes and fill several
   buckets are dealt among those.
3. A bucket sorts its suffixes by multikey quicksort over eight-byte characters, and the bytes before them likewise.
   Neighbours are compared byte by byte: for each offset of a window in its anchor's context, the neighbours that agree
   far enough to the right and to the left are one string. All but its earliest place (document, start) are repeats.
4. Where a bucket's splitter agrees with a suffix as far as a window reaches, that window may occur in other buckets.
   Its earliest place in the bucket is compared across the boundaries, under a BLAKE2b digest of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import bucket_count, by_bucket, group_starts, row_chunks, scratch, split_blobs, text_bytes, utf8, with_key, written

LENGTH, GRAM = 100, 40
REACH = LENGTH - GRAM  # the farthest that an anchor lies behind its window's start
#: Suffixes sampled for each splitter, and the most of them (100 bytes each reach the driver).
PER_SPLITTER, MOST_SAMPLED = 32, 1_000_000

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, MIX = 0x9E3779B97F4A7C15, U(0xBF58476D1CE4E5B9)
ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
CONTEXT = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("ctx", "u1", (REACH + LENGTH,))])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
DONE = 128  # flag in ``lo``: the entry is a candidate already
FLUSH = 800_000


def _power(base: int, n: int) -> np.uint64:
    return U(pow(base, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM``-byte string of ``data``."""
    h = TABLE[data]
    sizes = {1: h}
    n = 1
    while n < 32:
        h = h[:-n] * _power(BASE, n) + h[n:]
        n *= 2
        sizes[n] = h
    g = sizes[32][:-8] * _power(BASE, 8) + sizes[8][32:]
    g ^= g >> U(32)
    g *= MIX
    g ^= g >> U(29)
    return g


def anchors(data: np.ndarray, offs: np.ndarray):
    """Anchors in ``data`` (documents cut at ``offs``): index, hash, and the least and greatest offset of a window
    whose anchor it is (the window starts that far before it)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = gram_hashes(data)
    least = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    n = 1
    while n < 32:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    extra = REACH + 1 - 32
    least = np.minimum(least[:-extra], least[extra:])
    edge = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offs) >= LENGTH
    edge[offs[:-1][long]] += 1
    edge[offs[1:][long] - (LENGTH - 1)] -= 1
    starts = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[: len(least)])
    at = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(group_starts(at))
    last = np.r_[new[1:], len(at)] - 1
    a = at[new]
    return a, g[a], a - starts[last], a - starts[new]


def _table(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _blob_batch(rows):
    buckets, kinds, blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


BLOBS = "bucket int, kind int, blob binary"


def _find_anchors(n_buckets: int):
    """(key, text) -> blobs: 0 entries by hash, 1 candidates known here, which nothing is compared with, by document and place."""

    def flush(parts):
        e = _table(parts, ENTRY)
        e = e[np.argsort(e["h"], kind="stable")]
        first = group_starts(e["h"])
        again = ~first
        again[:-1] |= ~first[1:]
        ends = e[first].copy()
        ends["lo"] |= np.where(again[first], DONE, 0).astype(np.uint8)
        known = e[again]
        place = (known["doc"].astype(np.int64).view(np.uint64) ^ (known["pos"].astype(np.uint64) << U(40))) * MIX
        rows = []
        for kind, rec, deal in ((0, ends, ends["h"]), (1, known, place >> U(29))):
            rows += [(b, kind, blob) for b, blob in split_blobs((deal % U(n_buckets)).astype(np.int64), rec)]
        if rows:
            yield _blob_batch(rows)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            all_data, all_offs = utf8(batch.column(1))
            for r0, r1 in row_chunks(all_offs, 1 << 19):
                offs = all_offs[r0 : r1 + 1] - all_offs[r0]
                data = all_data[all_offs[r0] : all_offs[r1]]
                a, h, lo, hi = anchors(data, offs)
                if not len(a):
                    continue
                doc = np.searchsorted(offs, a, "right") - 1
                e = np.empty(len(a), ENTRY)
                e["h"], e["doc"], e["pos"], e["lo"], e["hi"] = h, keys[r0 + doc], a - offs[doc], lo, hi
                parts.append(e)
                held += len(e)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        yield from flush(parts)

    return run


def _read_blobs(batches) -> dict[int, list[bytes]]:
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
            held.setdefault(kind, []).append(blob.as_py())
    return held


def _records(held: dict[int, list[bytes]], kind: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(held.pop(kind, [])), dtype)


def _pick_candidates(batches):
    """Blobs of one bucket -> rows (doc, pos, reach) of the candidates."""
    held = _read_blobs(batches)
    e = _records(held, 0, ENTRY)
    order = np.argsort(e["h"], kind="stable")
    first = group_starts(e["h"][order])
    again = ~first
    again[:-1] |= ~first[1:]
    found = e[order[again]]
    for part in (found[found["lo"] < DONE], _records(held, 1, ENTRY)):
        for at in range(0, len(part), 100_000):
            f = part[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f["doc"].astype(np.int64)), pa.array(f["pos"].astype(np.int32)), pa.array((f["lo"].astype(np.int32) & 127) << 8 | f["hi"])],
                ["doc", "pos", "reach"],
            )


def _merge_spans(rec: np.ndarray) -> np.ndarray:
    """Touching or overlapping spans of each document as one."""
    if not len(rec):
        return rec
    rec = rec[np.lexsort((rec["start"], rec["doc"]))]
    doc, start, end = rec["doc"], rec["start"].astype(np.int64), rec["end"].astype(np.int64)
    new_doc = group_starts(doc)
    seg = np.cumsum(new_doc)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + seg * big) - seg * big  # greatest end so far in the document
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = np.empty(len(at), SPAN)
    out["doc"], out["start"], out["end"] = doc[at], start[at], reach[np.r_[at[1:], len(rec)] - 1]
    return out


def _route(heads: np.ndarray, splitters: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Range bucket by all bytes of a suffix; one that fills several buckets is dealt among them by ``salt``."""
    left, right = np.searchsorted(splitters, heads, "left"), np.searchsorted(splitters, heads, "right")
    return left + (salt % (right - left + 1).astype(np.uint64)).astype(np.int64)


def _heads(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c["ctx"][:, REACH:]).view(f"S{LENGTH}")[:, 0]


def _spans_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = np.empty(len(doc), SPAN)
    s["doc"], s["start"], s["end"] = doc, start, end
    return s


def _send_contexts(splitters: np.ndarray, n_buckets: int):
    """(key, text, cands) -> blobs: 0 contexts by range, 1 spans known here."""
    mix = _rng.integers(0, 1 << 63, CONTEXT["ctx"].shape[0] // 8, dtype=np.uint64) * U(2) + U(1)

    def flush(contexts):
        c = _table(contexts, CONTEXT)
        if not len(c):
            return
        words = np.ascontiguousarray(c["ctx"]).view(np.uint64)
        key = ((words ^ (words >> U(31))) * mix).sum(1, dtype=np.uint64) * MIX
        order = np.lexsort((c["pos"], c["doc"], key))
        c, key = c[order], key[order]
        # equal keys stand next to each other; only equal bytes count as equal
        first = group_starts(key)
        for name in ("lo", "hi"):
            first[1:] |= c[name][1:] != c[name][:-1]
        first[1:] |= (c["ctx"][1:] != c["ctx"][:-1]).any(1)
        k = c[~first]
        known = _merge_spans(_spans_of(k["doc"], k["pos"] - k["hi"], k["pos"] - k["lo"] + np.uint32(LENGTH)))
        c, key = c[first], key[first]
        rows = [(b, 0, blob) for b, blob in split_blobs(_route(_heads(c), splitters, key >> U(20)), c)]
        rows += [(b, 1, blob) for b, blob in split_blobs(known["doc"] % n_buckets, known)]
        yield _blob_batch(rows)

    def run(batches):
        contexts, held = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = utf8(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy())
            pos, reach = (flat.field(i).to_numpy() for i in range(2))
            pos, lo, hi = pos.astype(np.int64), reach >> 8, reach & 255
            padded = np.r_[np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)]
            for at in range(0, len(pos), 5_000):
                pick = slice(at, at + 5_000)
                base = offs[doc[pick]] + pos[pick]
                ctx = padded[base[:, None] + np.arange(REACH + LENGTH)]
                cols = np.arange(-REACH, LENGTH)
                # outside of the bytes that the anchor's windows cover nothing may count
                ctx[(cols < -hi[pick][:, None]) | (cols >= LENGTH - lo[pick][:, None])] = 0
                c = np.empty(len(base), CONTEXT)
                c["doc"], c["pos"], c["lo"], c["hi"], c["ctx"] = keys[doc[pick]], pos[pick], lo[pick], hi[pick], ctx
                contexts.append(c)
                held += len(c)
                if held >= FLUSH // 8:
                    yield from flush(contexts)
                    contexts, held = [], 0
        yield from flush(contexts)

    return run


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of eight-byte characters: each round sorts by one character those that are still tied."""
    order = np.arange(len(words))
    tied, group = np.arange(len(words)), np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        by = np.lexsort((words[order[tied], depth], group[tied]))
        order[tied] = order[tied][by]
        key = words[order[tied], depth]
        old = group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        single = new & np.r_[new[1:], True]
        tied = tied[~single]
        if not len(tied):
            break
    return order


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of bytes, how many leading ones agree."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _sort_rows(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes by multikey quicksort over their eight-byte characters."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return multikey_sort(wide.view(">u8").astype(np.uint64))


def repeats_in_bucket(c: np.ndarray, below: np.ndarray | None = None, above: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Spans of windows that occur at an earlier (document, start) of the bucket, and (digests, document, start) of the
    earliest places of windows that may occur in other buckets. ``below`` and ``above`` are the splitters on its sides."""
    if not len(c):
        return np.zeros(0, SPAN), ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    c = c[_sort_rows(c["ctx"][:, REACH:])]
    near = np.zeros(len(c), np.int64)  # bytes that the suffix shares with a splitter
    for splitter in (below, above):
        if splitter is not None:
            near = np.maximum(near, agreement(c["ctx"][:, REACH:], np.broadcast_to(splitter, (len(c), LENGTH))))
    shared = np.zeros(len(c), np.int64)  # bytes that the suffix shares with the one before
    for at in range(1, len(c), 20_000):
        end = min(len(c), at + 20_000)
        shared[at:end] = agreement(c["ctx"][at:end, REACH:], c["ctx"][at - 1 : end - 1, REACH:])
    new = shared < GRAM
    group = np.cumsum(new)
    alone = new & np.r_[new[1:], True] & (near < GRAM)
    c, near, shared, group = c[~alone], near[~alone], shared[~alone], group[~alone]
    spans, digests, docs, starts = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(c):
        end = int(np.searchsorted(group, group[min(at + 30_000, len(c)) - 1], "right"))
        found, (more, doc, start) = _repeats_of_groups(c[at:end], near[at:end], shared[at:end])
        spans.append(found)
        digests += more
        docs.append(doc)
        starts.append(start)
        at = end
    return _merge_spans(_table(spans, SPAN)), (digests, np.concatenate(docs), np.concatenate(starts))


def _repeats_of_groups(c: np.ndarray, near: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, tuple]:
    """As ``repeats_in_bucket``, of suffixes in order; ``shared`` is each one's agreement with the one before."""
    before = np.ascontiguousarray(c["ctx"][:, :REACH][:, ::-1])  # the bytes before the anchor, nearest first
    by_left = _sort_rows(before)
    shared_left = np.r_[0, agreement(before[by_left[1:]], before[by_left[:-1]])]
    by_place = np.lexsort((c["pos"], c["doc"]))
    lo, hi, pos = c["lo"].astype(np.int64), c["hi"].astype(np.int64), c["pos"].astype(np.int64)
    left = np.empty(len(c), np.int64)
    again_row, again_at, digests, open_row, open_at = [], [], [], [], []
    for o in range(int(lo.min()), int(hi.max()) + 1):
        right = np.cumsum(shared < LENGTH - o)  # one number for each string of LENGTH - o bytes from the anchor on
        left[by_left] = np.cumsum(shared_left < o)  # and of o bytes before it
        mine = by_place[(lo[by_place] <= o) & (o <= hi[by_place])]
        string = right[mine] * (len(c) + 1) + left[mine]
        order = np.argsort(string, kind="stable")
        first = group_starts(string[order])
        rows = mine[order[~first]]
        again_row.append(rows)
        again_at.append(np.full(len(rows), o))
        rows = mine[order[first]]
        rows = rows[near[rows] >= LENGTH - o]
        open_row.append(rows)
        open_at.append(np.full(len(rows), o))
        windows = np.ascontiguousarray(c["ctx"][rows, REACH - o : REACH - o + LENGTH])
        digests += [hashlib.blake2b(w, digest_size=16).digest() for w in windows]
    row, o = np.concatenate(again_row), np.concatenate(again_at)
    order = np.lexsort((o, row))
    row, o = row[order], o[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (o[1:] != o[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(row)][: len(at)] - 1
    spans = _spans_of(c["doc"][row[at]], pos[row[at]] - o[last], pos[row[at]] - o[at] + LENGTH)
    row, o = np.concatenate(open_row), np.concatenate(open_at)
    return spans, (digests, c["doc"][row].astype(np.int64), pos[row] - o)


def span_batches(spans: np.ndarray):
    for at in range(0, len(spans), 100_000):
        s = spans[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(s["doc"].astype(np.int64)), pa.array(s["start"].astype(np.int64)), pa.array(s["end"].astype(np.int64))], ["doc", "start", "end"])


SPANS = "doc long, start long, end long"


def _sort_buckets(splitters: np.ndarray):
    """Blobs of one bucket -> its spans (digest null) and its places to compare across boundaries."""
    bounds = np.frombuffer(splitters.tobytes(), np.uint8).reshape(-1, LENGTH)

    def run(batches):
        held, bucket = {}, 0
        for batch in batches:
            for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.setdefault(kind, []).append(blob.as_py())
                bucket = b
        known = _records(held, 1, SPAN)
        below = bounds[bucket - 1] if 0 < bucket <= len(bounds) else None
        above = bounds[bucket] if bucket < len(bounds) else None
        spans, (digests, doc, start) = repeats_in_bucket(_records(held, 0, CONTEXT), below, above)
        for found in span_batches(_merge_spans(np.concatenate([spans, known]))):
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.binary())], ["doc", "start", "end", "digest"])
        for at in range(0, len(doc), 100_000):
            d, s = doc[at : at + 100_000], start[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(s + LENGTH), pa.array(digests[at : at + 100_000], pa.binary())], ["doc", "start", "end", "digest"])

    return run


def _splitters(chosen: DataFrame, total: int, n: int) -> np.ndarray:
    """n - 1 suffixes that cut the candidates of ``chosen`` into ranges of like size, from a bounded sample."""
    every = max(1, total // min(MOST_SAMPLED, PER_SPLITTER * n))
    picked = F.filter("cands", lambda x: F.pmod(F.xxhash64("doc", x["pos"]), F.lit(every)) == 0)
    some = chosen.select(F.encode("text", "UTF-8").alias("data"), picked.alias("cands")).filter(F.size("cands") > 0)
    some = some.select("data", F.explode("cands").alias("x"))
    # zero where no window of the anchor reaches, as in a context
    head = F.substring(F.col("data"), F.col("x.pos") + 1, LENGTH - F.shiftright("x.reach", 8))
    heads = np.sort(np.array([bytes(r.head) for r in some.select(head.alias("head")).collect()], f"S{LENGTH}"))
    return heads[np.linspace(0, len(heads) - 1, n + 1).astype(int)[1:-1]] if len(heads) else heads


def repeated_spans(rows: DataFrame, n_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For (doc, text), ``doc`` a key as of ``with_key``: spans (doc, start, end) of bytes that a repeated window covers
    (they may overlap), and (doc, text) of at least all documents that have one. Each key is there once."""
    n = n_buckets or bucket_count(text_bytes(rows))
    with scratch(rows.sparkSession) as keep:
        found = by_bucket(rows.mapInArrow(_find_anchors(n), BLOBS), n).mapInArrow(_pick_candidates, "doc long, pos int, reach int")
        found = written(found, "candidates")
        by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("pos", "reach")).alias("cands"))
        chosen = keep(rows.join(by_doc.hint("merge"), "doc").select("doc", "text", "cands"), "candidate-docs")
        splitters = _splitters(chosen, found.count(), n)
        results = by_bucket(chosen.mapInArrow(_send_contexts(splitters, n), BLOBS), n).mapInArrow(_sort_buckets(splitters), f"{SPANS}, digest binary")
        results = keep(results, "bucket-results")
    # a digest is open once in a bucket, so its rows are as many as buckets that it may occur in
    later = F.row_number().over(Window.partitionBy("digest").orderBy("doc", "start"))
    across = results.filter("digest is not null").withColumn("nth", later).filter("nth > 1").select("doc", "start", "end")
    return results.filter("digest is null").select("doc", "start", "end").unionByName(across), chosen.select("doc", "text")


def union_of_spans(pairs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def cut_out(texts: DataFrame, spans: DataFrame, as_text: bool = False) -> DataFrame:
    """(doc, n_bytes, kept, spans) of the documents that have a span; the spans are merged.

    ``kept`` is binary, or with ``as_text`` a string without what a cut left of a character.
    """
    kind = "string" if as_text else "binary"

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            lists = batch.column(2)
            flat = lists.flatten()
            start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            kept, merged = [], []
            for i in range(len(offs) - 1):
                s = union_of_spans(zip(start[cuts[i] : cuts[i + 1]].tolist(), end[cuts[i] : cuts[i + 1]].tolist()))
                merged.append([{"start": a, "end": b} for a, b in s])
                kept.append(without_spans(raw[offs[i] : offs[i + 1]], s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc", "n_bytes", "kept", "spans"],
            )

    # by the hint the plan is the same at every size: texts move once, spans are never broadcast
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")).hint("merge")
    return texts.join(by_doc, "doc").select("doc", "text", "spans").mapInArrow(run, f"doc long, n_bytes long, kept {kind}, spans array<struct<start:long,end:long>>")


def digests(rows: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of (doc_id, text, doc) from its document's spans.

    Texts without a span are digested where they are read; only the others move.
    """
    text = F.coalesce("text", F.lit(""))
    whole = rows.select("doc_id", "doc", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("whole_sha256"))
    cut = cut_out(texts, spans).select("doc", F.length("kept").cast("long").alias("n_kept"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("sha"))
    both = whole.join(cut, "doc", "left")
    return both.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole_sha256").alias("kept_sha256")
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, doc) of every row and (doc, text) of every document; ``doc`` is its key (see ``with_key``)."""
    rows, repeated = with_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), name="doc")
    once = rows.select("doc", "text")
    return rows, once.dropDuplicates(["doc"]) if repeated else once


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, texts without what repeated 100-byte strings cover.

    A string is repeated if it also starts earlier: in a document that comes before or before in the same one; strings
    are judged on the input. No shorter string is removed, and matches never cross documents. What a cut inside of a
    character leaves of it goes too. Documents come in order of id (a null id first). Rows that repeat an id with
    another text are documents of their own, in order of their texts' digests; rows that agree in id and text are one
    document and end up alike. A null text has no bytes and stays null, an empty text stays empty. A text of any length
    is one row of a task and is worked on in one piece. An empty table gives an empty result. Other columns are kept as
    they are, whatever their names, except ``_key``, ``_own_digest`` and ``_kept``.
    """
    rows, repeated = with_key(docs, id_col, text_col)
    once = rows.select(F.col("_key").alias("doc"), F.col(text_col).alias("text"))
    spans, texts = repeated_spans(once.dropDuplicates(["doc"]) if repeated else once)
    changed = cut_out(texts, spans, True).select(F.col("doc").alias("_key"), F.col("kept").alias("_kept"))
    both = rows.join(changed, "_key", "left")
    return both.withColumn(text_col, F.coalesce("_kept", text_col)).select(docs.columns)


def op2(spark, root):
    """Query op2_suffix_dedup: bytes, removed bytes and spans, and the digest of what is left, of each document."""
    rows, once = keyed(spark.read.parquet(f"{root}/documents.parquet"))
    return digests(rows, *repeated_spans(once))
