import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import suffix


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def rows_for_test():
    rng = random.Random(5)
    vocab = ["the", "und", "été", "of", "naïve", "lorem", "ipsum", "x", "señor", "0123456789"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    line = "This very line is common to many of the documents here, 80 bytes."
    rows = []
    for i in range(90):
        parts = [text(rng.randrange(30)) for _ in range(3)] + [rng.choice(shared)[: rng.randrange(80, 200)] for _ in range(rng.randrange(3))] + [line] * (i % 2)
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 350), (103, "a" * 99), (104, "ab" * 200), (105, ""), (106, None), (107, "z" + rows[4][1] * 2), (108, "é" * 120), (109, line * 3)]
    return rows


def results(spark, rows, n_buckets=None):
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n_bytes int, doc int").repartition(5)
    keyed, once = suffix.keyed(docs)
    return suffix.digests(keyed, *suffix.repeated_spans(once, n_buckets)).collect()


@pytest.mark.parametrize("n_buckets", [None, 2, 60])
def test_matches_brute_force(spark, n_buckets):
    """With many buckets most runs of equal suffixes lie across boundaries."""
    rows = rows_for_test()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in results(spark, rows, n_buckets)}
    assert got == brute(rows)


def test_boundaries_hide_nothing():
    """Contexts dealt over buckets by few splitters: local repeats and open places together give all repeats."""
    rng = np.random.default_rng(7)
    texts = ["".join("ab"[b] for b in rng.integers(0, 2, 30)) * 4 + "".join("ab"[b] for b in rng.integers(0, 2, 160)) for _ in range(3)]
    texts = [texts[i % 3][i % 40 :] for i in range(60)]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    a, _, lo, hi = suffix.anchors(data, offs)
    doc = np.searchsorted(offs, a, "right") - 1
    c = np.zeros(len(a), suffix.CONTEXT)
    c["doc"], c["pos"], c["lo"], c["hi"] = doc, a - offs[doc], lo, hi
    padded = np.r_[np.zeros(60, np.uint8), data, np.zeros(100, np.uint8)]
    for i, (at, low, high) in enumerate(zip(a, lo, hi)):
        c["ctx"][i] = padded[at : at + 160]
        c["ctx"][i][: 60 - high] = 0
        c["ctx"][i][160 - low :] = 0
    whole = suffix.repeats_in_bucket(c)[0]
    for n in (1, 4, 30):
        splitters = np.sort(rng.choice(suffix._heads(c), n))
        bounds = np.frombuffer(splitters.tobytes(), np.uint8).reshape(-1, 100)
        bucket = suffix._route(suffix._heads(c), splitters, rng.integers(0, 1 << 40, len(c)).astype(np.uint64))
        spans, places = [], []
        for b in range(n + 1):
            found, (digests, docs, starts) = suffix.repeats_in_bucket(c[bucket == b], bounds[b - 1] if b else None, bounds[b] if b < n else None)
            spans.append(found)
            places += zip(digests, docs, starts)
        first = {}
        for d, i, s in sorted(places):
            if d in first:
                spans.append(suffix._spans_of(np.array([i]), np.array([s]), np.array([s + 100])))
            first[d] = i
        got = suffix._merge_spans(np.concatenate(spans))
        assert got.tolist() == whole.tolist()


def test_dedup_texts(spark):
    rows = rows_for_test()
    got = {r.doc_id: r.text for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[101] == "" and got[103] == "a" * 99 and got[106] is None


def test_repeated_and_null_ids_lose_nothing(spark):
    rng = random.Random(1)
    text, other = ("".join(rng.choice("abcdef ") for _ in range(150)) for _ in range(2))
    rows = [(None, text), (1, text), (1, text), (2, text), (2, other), (None, other + "!"), (3, None), (3, "")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in results(spark, rows)))
    assert got == [(False, 0, 150, 0), (False, 0, 151, 0), (True, 1, 150, 150), (True, 1, 150, 150), (True, 2, 150, 150), (True, 2, 150, 150), (True, 3, 0, 0), (True, 3, 0, 0)]
    kept = suffix.dedup(spark.createDataFrame([(1, text, 5), (2, text, 6), (2, other, 7), (2, other, 8)], "doc_id long, text string, doc int")).collect()
    assert sorted(map(tuple, kept)) == [(1, text, 5), (2, "", 6), (2, other, 7), (2, other, 8)]
    names = suffix.dedup(spark.createDataFrame([("a", text), ("b", text), ("b", other)], "doc_id string, text string")).collect()
    assert sorted(map(tuple, names)) == [("a", text), ("b", ""), ("b", other)]


def test_empty(spark):
    assert results(spark, []) == []
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts(spark):
    """Texts over a megabyte against their own halves: more than one chunk of rows and several blobs of a task."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(30_000)]
    long = " ".join(rng.choice(words) for _ in range(220_000))
    rows = [(0, long), (1, long[: 900_000] + "!" * 50), (2, " ".join(rng.choice(words) for _ in range(200)))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in results(spark, rows)}
    assert got == {0: (len(long), 0, 0), 1: (900_050, 900_000, 1), 2: (len(rows[2][1]), 0, 0)}


def test_the_query(spark, tmp_path):
    rows = rows_for_test()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = suffix.op2(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute(rows)


def test_multikey_sort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix.multikey_sort(words)
    assert [tuple(r) for r in words[order]] == sorted(tuple(r) for r in words)


def test_a_gram_of_all_documents_is_spread():
    """What a task knows to be a candidate is dealt by its place, so a line that all documents share fills no bucket."""
    rng = random.Random(8)
    line = "Licensed to whoever reads this line, without warranties or conditions of any kind, either express or implied. " * 2
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) + line for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], ["key", "text"])
    sizes = {}
    for out in suffix._find_anchors(16)([batch]):
        for bucket, kind, blob in zip(*(out.column(i).to_pylist() for i in range(3))):
            if kind == 1:
                sizes[bucket] = sizes.get(bucket, 0) + len(blob)
    assert len(sizes) == 16 and max(sizes.values()) < 2 * sum(sizes.values()) / 16
