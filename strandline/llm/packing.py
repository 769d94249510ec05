"""Sequence packing by length patterns and non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity``
numbers) reaches the driver. Patterns of one to three lengths that fill a sequence as far as they can are fitted to it
by non-negative least squares, a share of their repeat counts is rounded down, and what they leave (short pieces among
it, as fill) is packed best fit, longest first. The plan is a list of patterns with repeat counts; a piece finds its sequence and offset from its length and its
rank among pieces of that length alone, so the assignment needs no group, no driver and no order between tasks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import scratch

CAPACITY, END_ID = 1024, 2
#: Runs of white space that the JSON form encodes, looked for in texts of more characters than the first number; the
#: rank form takes runs of half a million.
LONG_TEXT, LONG_RUN = 100_000, re.compile(r"\s{5000}")
#: Weight of the unused capacity in the fit, and the share of the fitted repeats that is taken.
UNUSED_WEIGHT, SHARE = 3.0, 0.8
#: Rows of a rank group (length and salt), and the most salts.
GROUP_ROWS, MOST_SALTS = 50_000, 4096


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary as packed little-endian unsigned 32-bit numbers.

    The vocabulary's rank file gives the same ids as its JSON form without added tokens. Texts are cut at the strings of
    ``added`` first, which get their own ids; other special-token strings are ordinary text. The rank form is several
    times as fast, but its pattern goes back over runs of white space and fails on very long ones: texts with such a run
    are encoded by the JSON form.
    """

    def __init__(self, rank_file: str, pattern: str, json_file: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ordinary = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json_file, self._json_form = json_file, None
        self._added = {text: np.array([i], "<u4").tobytes() for text, i in added}
        # of strings that begin at one place the longest is taken, as the JSON form does
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def _plain(self, text: str) -> bytes:
        return np.array(self._ordinary(text), "<u4").tobytes()

    def _by_json(self, text: str) -> bytes:
        if self._json_form is None:
            from tokenizers import Tokenizer

            with open(self._json_file, encoding="utf-8") as file:
                form = json.load(file)
            form["added_tokens"] = [t for t in form["added_tokens"] if t["content"] in self._added]
            self._json_form = Tokenizer.from_str(json.dumps(form))
        return np.array(self._json_form.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_TEXT and LONG_RUN.search(text):
            return self._by_json(text)
        if not self._added or not self._cuts.search(text):
            return self._plain(text)
        return b"".join(self._added.get(part) or self._plain(part) for part in self._cuts.split(text) if part)


_loaded: dict[tuple, ByteBpe] = {}


def tokenizer(rank_file: str, pattern: str, json_file: str, added: tuple[tuple[str, int], ...] = ()) -> ByteBpe:
    """One tokenizer for each worker process and vocabulary."""
    key = rank_file, pattern, json_file, added
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]


def default_vocabulary() -> tuple[str, str, str]:
    """Rank file, split pattern and JSON form of the installed 50k byte vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def default_added() -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of that vocabulary's JSON form."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match their exact string are known")
    return tuple((t["content"], t["id"]) for t in tokens)


def token_pieces(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, input_ids]): each document's ids and ``end_id``, cut from the end into
    pieces of ``capacity``; the first may be shorter. A null text is empty and gives one piece of one token; so does an
    empty one. A text of any length is encoded whole by one task, its pieces leave in bounded batches. Repeated rows give
    their pieces each; a null id is an id. Strings of ``added`` get their ids (``default_added()``: as the JSON form
    does); without it they are ordinary text. Other columns are not read; an empty table gives an empty result."""
    form = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["input_ids"] * keep_ids

    def run(batches):
        encode = tokenizer(*form, added).encode
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                head = n % capacity or capacity
                at = 0
                for k in range(-(-n // capacity)):
                    size = head if k == 0 else capacity
                    part = data[4 * at : 4 * (at + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at += size
                if keep_ids and len(row) >= 2000 or len(row) >= 100_000:
                    yield out(batch, row, piece, start, length, crc, ids)
                    row, piece, start, length, crc, ids = [], [], [], [], [], []
            yield out(batch, row, piece, start, length, crc, ids)

    def out(batch, row, piece, start, length, crc, ids):
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", input_ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def length_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that the last piece fills as far as any length can; rows of three in
    rising order, 0 for none."""
    a = np.unique(lengths)
    rows = [np.stack([np.zeros_like(a), np.zeros_like(a), a], 1)]
    last = np.searchsorted(a, capacity - a, "right") - 1
    good = (last >= 0) & (a[last] >= a)
    rows.append(np.stack([np.zeros_like(a[good]), a[good], a[last[good]]], 1))
    for x in a[3 * a <= capacity]:
        y = a[(a >= x) & (2 * a <= capacity - x)]
        z = a[np.searchsorted(a, capacity - x - y, "right") - 1]
        y, z = y[z >= y], z[z >= y]
        rows.append(np.stack([np.full_like(y, x), y, z], 1))
    return np.concatenate(rows)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, capacity: int, tolerance: float = 5e-3, most_rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' lengths close to the histogram: least squares with one more
    row, the capacity that is left unused, whose target is 0.

    An active-set method: each round lets in patterns whose gradient is positive, such that no two of them share a
    length, solves for all that are in and drops those that would be negative, until no gradient exceeds ``tolerance``
    (of the greatest count). The result uses about as many patterns as there are lengths.
    """
    weight = patterns > 0
    unused = UNUSED_WEIGHT * (1 - patterns.sum(1) / capacity)
    target = np.r_[histogram.astype(float), 0.0]
    scale = max(1.0, target.max())
    target /= scale

    def columns(cols):
        made = np.zeros((len(target), len(cols)))
        for k in range(patterns.shape[1]):
            np.add.at(made, (patterns[cols, k], np.arange(len(cols))), weight[cols, k])
        made[-1] = unused[cols]
        return made

    inside, x, matrix = np.zeros(0, np.int64), np.zeros(0), np.zeros((len(target), 0))
    left, least, several = target, np.inf, True
    for _ in range(most_rounds):
        gradient = np.where(weight, left[patterns], 0).sum(1) + unused * left[-1]
        gradient[inside] = 0
        order = np.argsort(-gradient, kind="stable")[:2000]
        taken, new = np.zeros(len(target), bool), []
        for p in order[gradient[order] > tolerance]:
            parts = patterns[p][weight[p]]
            if not taken[parts].any():
                taken[parts] = True
                new.append(p)
        if not new:
            break
        new = np.array(new)
        inside, x, matrix = np.r_[inside, new], np.r_[x, np.zeros(len(new))], np.concatenate([matrix, columns(new)], 1)
        while True:
            gram = matrix.T @ matrix
            gram[np.diag_indices(len(gram))] += 1e-9
            found = np.linalg.solve(gram, matrix.T @ target)
            bad = found <= 1e-12
            if not bad.any():
                break
            if several:
                drop = bad
            else:  # go as far as the first that reaches 0
                x = np.maximum(x + np.min(x[bad] / np.maximum(x[bad] - found[bad], 1e-300)) * (found - x), 0)
                drop = bad & (x <= 1e-9)
            inside, matrix, x = inside[~drop], matrix[:, ~drop], x[~drop]
        x = found
        left = target - matrix @ x
        error = float(left @ left)
        # dropping several at once is fast, but only single steps are sure to come to an end
        several &= error < least * 0.9999
        least = min(least, error)
    out = np.zeros(len(patterns))
    out[inside] = x
    return out * scale


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(length, count)]) that use up the histogram: the longest first, then what fits best."""
    left, plan = left.copy(), []
    present = [int(x) for x in np.flatnonzero(left)]
    while present:
        space, parts = capacity, []
        i = len(present) - 1
        while i >= 0 and space:
            length = present[i]
            if length <= space:
                count = min(space // length, int(left[length]))
                parts.append((length, count))
                space -= count * length
            if space < present[0]:
                break
            i = min(i - 1, int(np.searchsorted(present, space, "right")) - 1)
        repeats = min(int(left[length]) // count for length, count in parts)
        for length, count in parts:
            left[length] -= repeats * count
        plan.append((repeats, parts))
        present = [x for x in present if left[x]]
    return plan


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns with repeats for all pieces; ``histogram[n]`` is the number of pieces of n tokens.

    Pieces that fill a sequence are patterns of their own; the others are fitted. ``SHARE`` of each repeat count is
    rounded down and taken as far as there are pieces for it, the largest counts first; the rest is packed best fit.
    """
    left, plan = histogram.copy(), []
    if left[capacity]:
        plan.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    present = np.flatnonzero(left)
    if len(present):
        patterns = length_patterns(present, capacity)
        repeats = fit_repeats(patterns, left, capacity)
        for p in np.argsort(-repeats, kind="stable"):
            if repeats[p] * SHARE < 1:
                break
            lengths, counts = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
            n = int(min(repeats[p] * SHARE, (left[lengths] // counts).min()))
            if n:
                left[lengths] -= n * counts
                plan.append((n, list(zip(lengths.tolist(), counts.tolist()))))
    return plan + best_fit(left, capacity)


def slots_of(plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, parts in plan:
        offset = 0
        for length, count in parts:
            rows.append((length, used.get(length, 0), sequence, count, offset))
            used[length] = used.get(length, 0) + repeats * count
            offset += length * count
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(slots: np.ndarray):
    key = (slots[:, 0] << 44) + slots[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            s = slots[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            k = rank - s[:, 1]
            columns = [batch.column(i) for i in range(5)] + [pa.array(s[:, 2] + k // s[:, 3]), pa.array(s[:, 4] + k % s[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Every row is packed, repeated ones and those of a null id as well; rows that agree in all columns take any of their
    places. Offsets are gapless from 0 in each sequence. An empty table gives an empty result; other columns are not
    read, so their names can't clash.
    """
    with scratch(pieces.sparkSession) as keep:
        rows = keep(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
        salts = int(min(MOST_SALTS, max(32, rows.count() // GROUP_ROWS)))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
        counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity x salts rows
        bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
        histogram = np.zeros(capacity + 1, np.int64)
        for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
            histogram[r.length] = r.n
        slots = slots_of(make_plan(histogram, capacity))
        place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
        ranked = salted.withColumn("place", F.row_number().over(place) - 1).join(bases, ["length", "salt"])
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).cast("long").alias("rank"))
        kind = pieces.schema["doc_id"].dataType.simpleString()
        return ranked.mapInArrow(_assign(slots), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(spark, root):
    """Query op8_packing: all documents in sequences of at most 1024 tokens."""
    return pack(token_pieces(spark.read.parquet(f"{root}/documents.parquet"), added=default_added()))
