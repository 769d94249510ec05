"""SimHash near-duplicates through covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of a document's shingle hashes. For a radius r every bit position i gets
the nonzero vector phi(i) = 1 + i mod (2^(r+1) - 1) over GF(2); table v (1 <= v < 2^(r+1)) keeps the bits whose phi is
not orthogonal to v. For any r positions some v is orthogonal to all of their phi, so two fingerprints that differ in at
most r bits agree in that table: nothing within the radius can be missed.

Only distinct fingerprints enter the tables. Buckets of up to ``SMALL`` fingerprints are compared in one task, which
hands on a star for each local component; larger ones are joined through shared one-bit neighbours (two fingerprints
differ in at most two bits if and only if they share one), so no bucket ever becomes all of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import scratch, utf8, written
from strandline.llm.graph import connected_components

BITS = 64
SEED = 42
#: Fingerprints of a bucket that one task compares; beyond it the neighbour form takes over.
SMALL = 2048


def masks(radius: int) -> list[int]:
    """The covering masks as unsigned 64-bit numbers."""
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if bin((1 + i % (size - 1)) & v).count("1") & 1) for v in range(1, size)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle (fewer words: of the whole sequence) of ASCII-lower-cased text."""
    words = text.lower().split()  # bytes.split() cuts at 0x20 and 0x09-0x0D, lower() maps A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[width:] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            values = [_signed(fingerprint(raw[a:b], width)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def local_stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, least value of its component) among distinct values of one bucket."""
    n = len(values)
    bits = values.view(np.uint64)
    label = np.arange(n)
    near = []
    for at in range(0, n, 256):
        a, b = np.nonzero(np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= radius)
        keep = a + at > b
        near.append(np.stack([a[keep] + at, b[keep]]))
    a, b = np.concatenate(near, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = np.full(n, n)
    np.minimum.at(least, label, rank)
    root = values[order[least[label]]]
    keep = root != values
    return values[keep], root[keep]


def _stars(radius: int):
    def run(batches):
        for batch in batches:
            us, vs = [], []
            values, offs = batch.column(0).flatten().to_numpy(), np.r_[0, np.cumsum(batch.column(0).value_lengths().to_numpy())]
            for a, b in zip(offs[:-1], offs[1:]):
                u, v = local_stars(values[a:b], radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) over distinct ``fp`` whose components are those of all pairs within the radius (at most 2)."""
    if radius > 2:
        raise ValueError("large buckets are joined through one-bit neighbours, which reach two bits")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks(radius))])
    members = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    sizes = members.groupBy("t", "k").count().filter("count > 1")
    shared = written(members.join(sizes, ["t", "k"]), "buckets")
    small = shared.filter(F.col("count") <= SMALL).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    near = small.select("fps").mapInArrow(_stars(radius), "u long, v long")
    large = shared.filter(F.col("count") > SMALL).select("fp").distinct()
    steps = [0] + [_signed(1 << i) for i in range(BITS)]
    around = large.select("fp", F.explode(F.array(*[F.lit(s) for s in steps])).alias("s")).select("fp", F.col("fp").bitwiseXOR(F.col("s")).alias("z"))
    hubs = around.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("z", "v")
    far = around.join(hubs, "z").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(far if radius == 2 else far.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))


def components(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of at most ``radius`` differing bits. Documents without words
    share fingerprint zero and are linked like any other. Rows repeated with one doc_id are rows of the result each; a
    null doc_id counts as larger than any other when the least is taken. Null and empty texts have no words. A text of any
    length is hashed whole by one task. An empty table gives an empty result; other columns are not read, so their names
    can't clash.
    """
    with scratch(docs.sparkSession) as keep:
        prints = keep(fingerprints(docs, width, id_col, text_col), "fingerprints")
        nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        found = connected_components(links(prints.select("fp").distinct(), radius))
        labels = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
        labels = written(labels, "labels")
        roots = labels.groupBy("c").agg(F.min("least").alias("component_id"))
        named = keep(labels.join(roots, "c").select("fp", "component_id"), "named")
        return prints.join(named, "fp")


def op10(spark, root):
    """Query op10_simhash: fingerprint and component of each document, radius 2, three-word shingles."""
    found = components(spark.read.parquet(f"{root}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
