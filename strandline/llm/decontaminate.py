"""Benchmark decontamination by pigeonhole pieces and bit-parallel verification.

An item of m bytes may occur with k = m // ``bytes_per_error`` edits (m without the spaces at its ends). Cut into k + 1 pieces, at least one piece survives
any k edits unchanged, so an Aho-Corasick automaton over all pieces finds a hit in every true occurrence. Around each
hit the item is searched with Myers' bit-parallel edit distance, free at both ends of the window.

Texts and items are compared after lower-casing, with everything but letters, digits and bytes beyond ASCII as word
ends, words joined by one space and a space at either end; distances count bytes of this form. So an item without an
edit matches whole words only: "in" is not found in "inside".

The benchmark is brought into this form by tasks and written as a table of blocks of bounded size. One block at a time
is broadcast and searched for in all documents; a worker builds a block's automaton once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import scratch, written

#: Benchmark bytes that one pass over the documents searches for; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20

_KEEP = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(128)) + bytes(range(128, 256))


def normal(text: str | None) -> bytes:
    """The form that is compared; empty for a text without words."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_KEEP).split()
    return b" " + b" ".join(words) + b" " if words else b""


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: bytes, window: bytes, masks: dict[int, int] | None = None) -> tuple[int, int]:
    """(least edit distance between ``item`` and any substring of ``window``, end of the first such substring)."""
    m = len(item)
    if masks is None:
        masks = item_masks(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise = down | ~(horizontal | up)
        fall = up & horizontal
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
            if score < best:
                best, end = score, i
        rise <<= 1
        fall <<= 1
        up = (fall | ~(vertical | rise)) & full
        down = rise & vertical & full
    return best, end


def item_masks(item: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@dataclass
class Matcher:
    """All pieces of a block of items as one automaton."""

    items: list[tuple[int, bytes]]
    bytes_per_error: int

    def __post_init__(self):
        self.errors = [(len(item) - 2) // self.bytes_per_error for _, item in self.items]  # the spaces at its ends add none
        self.masks: dict[int, dict[int, int]] = {}
        places: dict[bytes, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, self.errors[i]):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: bytes) -> dict[int, int]:
        """Item number -> least distance, of the items that occur within their budget."""
        if self.empty:
            return {}
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text.decode("latin-1")):
            for i, offset in where:
                starts.setdefault(i, set()).add(end + 1 - length - offset)
        found = {}
        for i, at in starts.items():
            item, k = self.items[i][1], self.errors[i]
            if i not in self.masks:
                self.masks[i] = item_masks(item)
            best, reach = k + 1, None
            spans: list[list[int]] = []
            for s in sorted(at):
                a, b = max(0, s - k), s + len(item) + k
                if spans and a <= spans[-1][1] and b - spans[-1][0] <= 8 * len(item):
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, reach in spans:
                best = min(best, myers(item, text[a:reach], self.masks[i])[0])
                if not best:
                    break
            if best <= k:
                found[i] = best
        return found


_built: dict[str, Matcher] = {}


def _matcher(name: str, block, bytes_per_error: int) -> Matcher:
    """The automaton of a broadcast block; a worker keeps the last one that it built."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(block.value, bytes_per_error)
    return _built[name]


def _normal_items(batches):
    for batch in batches:
        found = [normal(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["item_id", "item"])


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_bytes: int = 0) -> tuple[DataFrame, int]:
    """((block, item_id, item) with each normal form of at least ``least_bytes`` bytes once for each id, number of blocks).

    A block is meant to hold half of ``BLOCK_BYTES``; items are dealt to blocks by hash, which keeps it under
    ``BLOCK_BYTES`` unless a single item is larger.
    """
    raw = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = raw.mapInArrow(_normal_items, "item_id long, item binary").filter(F.octet_length("item") >= max(1, least_bytes)).distinct()
    items = written(items, "items")
    blocks = max(1, -(-2 * int(items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) // BLOCK_BYTES))
    return items.select(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)).alias("block"), "item_id", "item"), blocks


def _block(items: DataFrame, number: int):
    """(name, broadcast list of (item_id, item)) of one block."""
    spark = items.sparkSession
    rows = [(r.item_id, bytes(r.item)) for r in items.filter(F.col("block") == number).select("item_id", "item").collect()]
    return uuid.uuid4().hex, spark.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, bytes_per_error: int = 25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_bytes: int = 0
) -> DataFrame:
    """(doc_id, item_id, distance): each benchmark item that a document holds within its edit budget.

    Items without a word (null, empty, stops only) match nothing, nor do items of less than ``least_bytes`` bytes; items
    with one text are reported each; an item row that is repeated counts once. Null and empty texts hold nothing; a
    repeated document row gives its rows again; null ids are kept. Empty tables give an empty result. A text of any
    length is searched whole by one task. Other columns are not read, so their names can't clash. Documents are not
    shuffled; a benchmark of several blocks takes a pass over them for each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id long, distance int"

    def search(name, block):
        def run(batches):
            matcher = _matcher(name, block, bytes_per_error)
            for batch in batches:
                ids, which, dist = [], [], []
                for n, text in enumerate(batch.column(1)):
                    for i, d in matcher.find(normal(text.as_py())).items():
                        ids.append(n)
                        which.append(matcher.items[i][0])
                        dist.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(which, pa.int64()), pa.array(dist, pa.int32())], ["doc_id", "item_id", "distance"])

        return rows.mapInArrow(run, schema)

    with scratch(docs.sparkSession) as keep:
        items, blocks = item_blocks(benchmark, item_col, item_text_col, least_bytes)
        if blocks == 1:
            return search(*_block(items, 0))
        out = None
        for number in range(blocks):
            name, block = _block(items, number)
            found = keep(search(name, block), "leaks")
            block.unpersist()
            out = found if out is None else out.unionByName(found)
        return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, bytes_per_error: int = 25, text_col: str = "text", least_bytes: int = 25) -> DataFrame:
    """The rows of ``docs``, with all of their columns, that hold no benchmark item; nothing is shuffled.

    An item of less than ``least_bytes`` bytes (a word or two, which much of a corpus holds) takes no document away.
    Null and empty texts stay, and so do rows with a null id; repeated rows stay or go alike. Empty tables give what is
    left of them. Names of other columns can't clash. With several blocks of items what is left is written after each.
    """
    at = docs.columns.index(text_col)

    def clean(docs, name, block):
        def run(batches):
            matcher = _matcher(name, block, bytes_per_error)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    with scratch(docs.sparkSession) as keep:
        items, blocks = item_blocks(benchmark, least_bytes=least_bytes)
        for number in range(blocks - 1):
            docs = written(clean(docs, *_block(items, number)), "clean")
        last = clean(docs, *_block(items, blocks - 1))
        return last if blocks == 1 else keep(last, "clean")


def op7(spark, root):
    """Query op7_decontamination: the leaked benchmark items of each document that holds one."""
    return find_leaks(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet"))
