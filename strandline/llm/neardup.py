"""Near-duplicate documents: SimHash tables and min-wise bands as candidates, set similarity as the judge.

Texts with a similarity (Jaccard, of sets of five-word shingles) of 0.8 have 64-bit SimHash fingerprints that differ in
some ten bits; radius 2, which the covering tables guarantee, sees only the nearest of them. So that a similarity
threshold can be kept, bands of min-wise hashes add candidates: with 12 bands of 4 hashes a pair at 0.8 is met with
probability 0.998. Every pair at the threshold or above that shares a bucket is found:

* In a bucket of up to ``PAIRS`` documents all pairs are compared.
* In a larger one every document is first compared with the bucket's least and greatest document and with the lesser
  document whose fingerprint is nearest to its own (among ``SMALL`` documents about). Buckets that
  these links leave apart are joined exactly: shingles are ordered from the rare to the commonest, and two sets of sizes a <= b at threshold t
  share one among the first a - ceil(2ta/(1+t)) + 1 of the smaller and the first b - ceil(tb) + 1 of the larger; the
  first one that they share leaves room for an overlap of t(a+b)/(1+t). A passage that a whole group shares comes last
  in this order, so strangers of the group don't meet.

Bottom-k sketches decide pairs of sets that they hold whole. Of larger sets they only drop pairs ``MARGIN`` below the
threshold (six deviations); the others are decided on all shingle hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm._shared import scratch, utf8, with_key, written
from strandline.llm.graph import connected_components

BANDS, ROWS, SKETCH = 12, 4, 256
#: Documents of a bucket all of whose pairs are compared.
PAIRS = 32
#: Documents of a larger bucket among which one task looks for nearest fingerprints.
SMALL = 1024
#: How far below the threshold a sketch of a larger set must be to drop a pair.
MARGIN = 0.15
#: One of so many documents is asked how common shingles are, and the most common ones that are told apart by their
#: counts (16 bytes each are broadcast). The order of shingles steers the work; with any order all pairs are met.
COUNTED, MOST_COMMON = 8, 4_000_000
#: Shingle hashes in one batch of rows.
POSTINGS = 1 << 18
_rng = np.random.Generator(np.random.PCG64(5))
FACTORS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(SimHash fingerprint, band keys, ascending bottom-k of 32-bit shingle hashes) of one text."""
    hashes = simhash.shingle_hashes(text, words)
    distinct = np.unique(hashes)
    if not len(distinct):
        return 0, np.zeros(BANDS, np.int64), np.zeros(0, np.uint32)
    least = np.full(len(FACTORS), np.uint64((1 << 64) - 1))
    for at in range(0, len(distinct), 1 << 14):
        mixed = distinct[None, at : at + (1 << 14)] * FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1))
    keys = (least.reshape(BANDS, ROWS) * FACTORS[:ROWS, 0]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    small = np.unique((distinct >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return simhash.fingerprint_of(hashes), keys.view(np.int64), small


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two bottom-k sketches; 1 for two empty ones."""
    both = np.union1d(a, b)[:SKETCH]
    return np.isin(both, a[np.isin(a, b, assume_unique=True)], assume_unique=True).mean() if len(both) else 1.0


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            found = [sketch(raw[a:b], words) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            marks = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            columns = [
                batch.column(0),
                pa.array([simhash._signed(f) for f, _, _ in found], pa.int64()),
                pa.array([k for _, k, _ in found], pa.list_(pa.int64())),
                pa.array([s.tobytes() for _, _, s in found], pa.binary()),
                pa.array(marks, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "bands", "sketch", "mark"])

    return run


def _similar(threshold: float):
    """Pairs that may be similar; ``open`` where a sketch doesn't hold its whole set, so that more has to decide."""

    def run(batches):
        for batch in batches:
            good, more = [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                more.append(max(len(a), len(b)) >= SKETCH)
                good.append(similarity(a, b) >= threshold - MARGIN * more[-1])
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, pa.bool_())], ["u", "v", "open"])
            yield found.filter(pa.array(good, pa.bool_()))

    return run


def _same_sets(threshold: float):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both / max(1, len(a) + len(b) - both) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            found = [np.unique(simhash.shingle_hashes(raw[a:b], words)).tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "hashes"])

    return run


def _counted(batches):
    """(doc_id, hashes) -> (s, n): how many of these documents have a shingle."""
    for batch in batches:
        held = [np.zeros(0, np.int64)]
        for hashes in batch.column(1):
            held.append(np.frombuffer(hashes.as_py(), np.int64))
            if sum(map(len, held)) > POSTINGS:
                held = [np.concatenate(held)]
                yield _unique(held.pop())
                held = [np.zeros(0, np.int64)]
        yield _unique(np.concatenate(held))


def _unique(hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(hashes, return_counts=True)], ["s", "n"])


def prefix(hashes: np.ndarray, common: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set in order of (how common, hash) by which any set as similar as ``threshold`` is met;
    ``common`` are the ascending common shingles, ``often`` how often they occur, all others count as equally rare."""
    at = np.searchsorted(common, hashes)
    known = at < len(common)
    known[known] = common[at[known]] == hashes[known]
    weight = np.zeros(len(hashes), np.int64)
    weight[known] = often[at[known]]
    keep = len(hashes) - int(np.ceil(threshold * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, weight))[:keep]]


def _prefixes(common, often, threshold: float):
    """(doc_id, hashes) -> (doc_id, size, s, at): the prefix of each set, ``at`` counting from 0."""

    def run(batches):
        for batch in batches:
            for doc, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(hashes.as_py(), np.int64)
                first = prefix(found, common.value, often.value, threshold)
                for k in range(0, len(first), POSTINGS):
                    part = first[k : k + POSTINGS]
                    columns = [np.full(len(part), doc), np.full(len(part), len(found)), part, np.arange(k, k + len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "size", "s", "at"])

    return run


def _all_pairs(batches):
    for batch in batches:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids, cuts = batch.column(0).flatten().to_numpy(), np.r_[0, np.cumsum(batch.column(0).value_lengths().to_numpy())]
        for a, b in zip(cuts[:-1], cuts[1:]):
            members = np.sort(ids[a:b])
            more, less = np.tril_indices(len(members), -1)
            us.append(members[more])
            vs.append(members[less])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def nearest_lesser(ids: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, lesser id with the nearest fingerprint, the least of equals) of all but the least of distinct ids."""
    order = np.argsort(ids, kind="stable")
    ids, bits = ids[order], prints[order].view(np.uint64)
    best = np.zeros(len(ids), np.int64)
    for at in range(0, len(ids), 256):
        part = bits[at : at + 256, None] ^ bits[None, : at + 256]
        apart = np.bitwise_count(part).astype(np.int16)
        apart[np.arange(apart.shape[1])[None, :] >= at + np.arange(len(apart))[:, None]] = 99
        best[at : at + 256] = apart.argmin(1)
    return ids[1:], ids[best[1:]]


def _nearest(batches):
    for batch in batches:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        members = batch.column(0).flatten()
        ids, prints = members.field(0).to_numpy(), members.field(1).to_numpy()
        cuts = np.r_[0, np.cumsum(batch.column(0).value_lengths().to_numpy())]
        for a, b in zip(cuts[:-1], cuts[1:]):
            u, v = nearest_lesser(ids[a:b], prints[a:b])
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _apart(sets: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u > v, of different components: all pairs of ``sets`` (doc_id, hashes) that can reach the threshold."""
    some = sets.filter(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTED)) == 0)
    counts = some.mapInArrow(_counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = written(counts, "common-shingles")
    # at most MOST_COMMON shingles are told apart by their counts; where more are common, rare means less rare
    rare = 1
    while (found := counts.filter(F.col("n") > rare)).count() > MOST_COMMON:
        rare *= 2
    table = found.orderBy("s").toArrow()
    context = sets.sparkSession.sparkContext
    common, often = (context.broadcast(table.column(c).to_numpy()) for c in ("s", "n"))
    first = sets.mapInArrow(_prefixes(common, often, threshold), "doc_id long, size long, s long, at long")
    first = written(first, "all-prefixes")
    shared = first.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select("s")
    first = first.join(shared, "s")
    labels = components.select(F.col("node").alias("doc_id"), "component")
    first = first.join(labels, "doc_id", "left").select("doc_id", "size", "s", "at", F.coalesce("component", "doc_id").alias("c"))
    first = written(first, "prefixes")
    mixed = written(first.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("s"), "mixed")
    first = first.join(mixed, "s")
    share = 2 * threshold / (1 + threshold)
    less = first.filter(F.col("at") <= F.col("size") - F.ceil(share * F.col("size") - 1e-9)).select("s", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "size", "at", "c")))
    smaller = F.struct("size_a", "doc_id_a") < F.struct("size", "doc_id")
    room = F.least(F.col("size_a") - F.col("at_a"), F.col("size") - F.col("at")) >= share / 2 * (F.col("size_a") + F.col("size")) - 1e-9
    met = less.join(first, "s").filter((F.col("c_a") != F.col("c")) & smaller & (F.col("size_a") >= threshold * F.col("size") - 1e-9) & room)
    return met.select(F.greatest("doc_id_a", "doc_id").alias("u"), F.least("doc_id_a", "doc_id").alias("v")).distinct()


def near_links(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(twins, links), both (u, v) with u > v, for (doc_id long, text) with each id once: documents with the shingles of a
    lesser one, and pairs of other documents with ``threshold`` similarity or more, enough of them to connect all that
    share a bucket (see the module)."""
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = written(rows.mapInArrow(_sketches(words), "doc_id long, fp long, bands array<long>, sketch binary, mark binary"), "sketches")
    # documents with one sketch and fingerprint are alike if the sketch is their whole set or the text is the same
    whole = F.when(F.octet_length("sketch") < 4 * SKETCH, F.lit(b"")).otherwise(F.col("mark"))
    alike = made.withColumn("same", F.sha2(F.concat("sketch", F.to_binary(F.hex("fp"), F.lit("hex")), whole), 256))
    groups = alike.groupBy("same").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).filter("n > 1")
    # written, so that both sides of the join are plain exchanges, whose hot partitions Spark can split
    groups = written(groups.select("same", "v"), "alike")
    twins = alike.select("doc_id", "same").join(groups, "same").filter("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    twins = written(twins, "twins")
    kept = written(made.join(twins, made["doc_id"] == twins["u"], "left_anti"), "firsts")
    cover = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(simhash._signed(m))).alias("k")) for i, m in enumerate(simhash.masks(2))]
    bands = [F.struct(F.lit(100 + i).alias("t"), F.col("bands")[i].alias("k")) for i in range(BANDS)]
    keys = kept.select("doc_id", "fp", F.explode(F.array(*cover, *bands)).alias("b")).select("doc_id", "fp", "b.t", "b.k")
    hubs = keys.groupBy("t", "k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).filter("n > 1")
    members = written(keys.join(hubs, ["t", "k"]), "members")
    few = members.filter(F.col("n") <= PAIRS).groupBy("t", "k").agg(F.collect_list("doc_id").alias("ids"))
    many = members.filter(F.col("n") > PAIRS)
    met = many.select("doc_id", F.explode(F.array("least", "most")).alias("hub")).filter("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v"))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / SMALL))
    dealt = many.groupBy("t", "k", part.alias("part")).agg(F.collect_list(F.struct("doc_id", "fp")).alias("docs"))
    near = dealt.select("docs").mapInArrow(_nearest, "u long, v long")
    pairs = met.unionByName(near).unionByName(few.select("ids").mapInArrow(_all_pairs, "u long, v long")).distinct()

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return written(rows.join(ids, "doc_id").select("doc_id", "text").mapInArrow(_sets(words), "doc_id long, hashes binary"), name)

    def judged(pairs: DataFrame) -> DataFrame:
        left, right = kept.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a")), kept.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b"))
        compared = written(pairs, "pairs").join(left, "u").join(right, "v").select("u", "v", "a", "b")
        compared = written(compared.mapInArrow(_similar(threshold), "u long, v long, open boolean"), "compared")
        undecided = compared.filter("open").select("u", "v")
        sets = sets_of(undecided.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "sets")
        left, right = sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
        decided = undecided.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_same_sets(threshold), "u long, v long")
        return written(compared.filter("not open").select("u", "v").unionByName(decided), "links")

    links = judged(pairs)
    if not many.isEmpty():
        found = connected_components(links)
        # a bucket whose documents are connected already has no pair left to find
        placed = many.select("t", "k", "doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("t", "k", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        placed = written(placed, "placed")
        apart = written(placed.groupBy("t", "k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("t", "k"), "apart")
        crowd = written(placed.join(apart, ["t", "k"]).select("doc_id").distinct(), "crowd")
        if not crowd.isEmpty():
            links = links.unionByName(judged(_apart(sets_of(crowd, "crowd-sets"), found, threshold)))
    return twins, links


def one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of linked documents the first one stays.

    Documents come in order of id (a null id first). Rows that repeat an id with another text are documents of their
    own, in order of their texts' digests; of rows that agree in id and text the one with the least hash of all columns
    stays. Null texts are empty; texts without words are alike. Whole texts of any length are read. An empty table gives
    an empty result. Other columns are kept as they are, whatever their names, except ``_key`` and ``_own_digest``.
    """
    rows, repeated = with_key(docs, id_col, text_col)
    with scratch(docs.sparkSession) as keep:
        once = rows.select(F.col("_key").alias("doc_id"), F.col(text_col).alias("text"))
        twins, links = near_links(once.dropDuplicates(["doc_id"]) if repeated else once, words, threshold)
        # a twin goes whatever becomes of the lesser document, so only the others need components
        found = connected_components(links).filter("node <> component").select(F.col("node").alias("_key"))
        gone = found.unionByName(twins.select(F.col("u").alias("_key"))).distinct()
        if not repeated:
            gone = keep(gone, "gone")
            return rows.join(gone, "_key", "left_anti").select(docs.columns)
        plain = [c for c, kind in docs.dtypes if "map<" not in kind]
        left = rows.join(gone, "_key", "left_anti").groupBy("_key").agg(F.min_by(F.struct(docs.columns), F.xxhash64(*plain)).alias("_row"))
        return keep(left, "kept").select("_row.*")
