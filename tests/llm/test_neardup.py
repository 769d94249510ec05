import random

import numpy as np
import pyarrow as pa

from strandline.llm import neardup, simhash


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def make_rows():
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 220))]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    return rows + [(n, rows[0][1]), (n + 1, None), (n + 2, " "), (n + 3, "few words"), (n + 4, "Few  words"), (n + 5, " ".join(rng.choice(vocab) for _ in range(9000)))]


def test_groups_match_brute_force(spark):
    rows = make_rows()
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    want = {i for i in parent if top(i) == i}
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "x", 2)], "doc_id long, text string, node int").repartition(3)
    kept = [r.doc_id for r in neardup.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want | {None}


def test_sketch_similarity_is_exact_for_short_texts():
    rows = make_rows()[:40]
    for i, a in rows:
        for j, b in rows:
            if max(len(shingles(a)), len(shingles(b))) <= 120:
                assert abs(neardup.similarity(neardup.sketch(a.encode(), 5)[2], neardup.sketch(b.encode(), 5)[2]) - jaccard(a, b)) < 1e-9


def test_fingerprint_is_that_of_the_operator():
    text = b"one two three four five six seven"
    assert neardup.sketch(text, 5)[0] == simhash.fingerprint(text, 5)
    assert len(neardup.sketch(b"", 5)[1]) == neardup.BANDS and isinstance(neardup.sketch(b"", 5)[2], np.ndarray)


def test_repeated_ids_lose_no_text(spark):
    long = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    rows = [(1, long[0], "a"), (2, long[0], "b"), (2, long[1], "c"), (2, long[1], "c"), (None, long[2], "d"), (None, long[3], "e"), (3, long[3], "f"), (4, None, "g"), (4, "", "g")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.mark) for r in kept) == sorted((i or 0, t or "", m) for i, t, m in [rows[0], rows[2], rows[4], rows[5], rows[7]])
    kept = neardup.one_of_each(spark.createDataFrame(rows[:3], "doc_id long, text string, mark string")).collect()
    assert sorted(r.mark for r in kept) == ["a", "c"]


def test_empty(spark):
    assert neardup.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nearest_lesser_matches_brute_force():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 300, 700):
        ids = rng.permutation(10 * n)[:n].astype(np.int64)
        prints = rng.integers(0, 1 << 6, n).astype(np.int64) - 20
        u, v = neardup.nearest_lesser(ids, prints)
        known = dict(zip(ids.tolist(), prints.tolist()))
        want = {x: min((bin((known[x] ^ known[y]) & (1 << 64) - 1).count("1"), y) for y in known if y < x)[1] for x in known if x != min(known)}
        assert dict(zip(u.tolist(), v.tolist())) == want


def test_strangers_as_hubs_hide_no_pair(spark, monkeypatch):
    """All documents share every bucket; only two in the middle are alike."""

    def one_bucket(batches):
        for batch in batches:
            made = [neardup.sketch(t.as_py().encode(), 5) for t in batch.column(1)]
            bands = pa.array([[7] * neardup.BANDS for _ in made], pa.list_(pa.int64()))
            prints = pa.array([simhash._signed(f) for f, _, _ in made], pa.int64())
            marks = pa.array([t.as_py().encode() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, bands, pa.array([s.tobytes() for _, _, s in made], pa.binary()), marks], ["doc_id", "fp", "bands", "sketch", "mark"])

    monkeypatch.setattr(neardup, "_sketches", lambda words: one_bucket)
    rng = random.Random(3)
    rows = [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(120))) for i in range(9)]
    rows[5] = (5, rows[4][1] + " more")
    kept = {r.doc_id for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(9)) - {5}


def groups_of(n_docs, passage, own, seed):
    """Documents with one long passage (strangers stay under 0.8); every tenth is a near copy of one further on."""
    rng = random.Random(seed)
    shared = [f"p{i}" for i in range(passage)]
    rows = [(i, shared + [f"d{i}x{k}" for k in range(own)]) for i in range(n_docs)]
    for i in range(0, n_docs // 2, 10):
        j = n_docs // 2 + rng.randrange(n_docs // 20) * 10 + 5
        rows[j] = (j, rows[i][1][:-3] + [f"e{j}", f"f{j}", f"g{j}"])
    return [(i, " ".join(words)) for i, words in rows]


def test_pairs_of_a_template_group(spark):
    """Hundreds of strangers share buckets by a common passage; near copies among them are found all the same."""
    for seed, (passage, own) in enumerate([(150, 25), (150, 19)]):
        rows = groups_of(400, passage, own, seed)
        assert 0.6 < jaccard(rows[1][1], rows[2][1]) < 0.8
        gone = {j for j, b in rows for i, a in rows if i % 10 == 0 and i < 200 <= j and j % 10 == 5 and jaccard(a, b) >= 0.8}
        assert len(gone) > 10
        kept = {r.doc_id for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {i for i, _ in rows} - kept == gone


def test_long_texts_are_judged_by_their_whole_sets(spark):
    """Around 0.8 the sketch of a long text often errs; pairs at 0.82 are linked, those at 0.78 are not."""
    rows, want = [], set()
    for k in range(30):
        words = [f"k{k}w{i}" for i in range(1000)]
        changed = 99 if k % 2 else 124
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-changed] + [f"n{k}w{i}" for i in range(changed)]))]
        similar = jaccard(rows[-1][1], rows[-2][1])
        assert 0.815 < similar < 0.825 if k % 2 else 0.775 < similar < 0.785
        want |= {2 * k} if similar >= 0.8 else {2 * k, 2 * k + 1}
    assert {r.doc_id for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_prefixes_of_similar_sets_meet():
    """Whatever is common: sets of 0.8 similarity or more share a shingle of their prefixes."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        pool = rng.choice(1 << 40, 60, replace=False)
        a = np.sort(rng.choice(pool, rng.integers(5, 55), replace=False))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.92], rng.choice(pool, 3)])
        common = np.sort(rng.choice(pool, 20, replace=False))
        often = rng.integers(2, 50, 20)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            met += 1
            assert len(np.intersect1d(neardup.prefix(a, common, often, 0.8), neardup.prefix(b, common, often, 0.8)))
    assert met > 50


def test_prefix_join_matches_brute_force(spark, monkeypatch):
    """With every bucket taken for a large one the groups are those of all pairs."""
    monkeypatch.setattr(neardup, "PAIRS", 1)
    test_groups_match_brute_force(spark)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base[: rng.randrange(40, 61)] + [f"o{rng.randrange(40)}" for _ in range(rng.randrange(0, 14))]) for _ in range(60)]
    sets = {i: np.unique(simhash.shingle_hashes(t.encode(), 5)) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "doc_id long, hashes binary")
    met = {(r.u, r.v) for r in neardup._apart(frame, spark.createDataFrame([], "node long, component long"), 0.8).collect()}
    want = {(i, j) for i in sets for j in sets if i > j and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= met
