import itertools
import random

import numpy as np
import xxhash

from strandline.llm import simhash
from strandline.llm.graph import connected_components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in ids}


def test_masks_cover_every_pair_of_positions():
    found = simhash.masks(2)
    assert len(found) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not (m >> a | m >> b) & 1 for m in found)


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)]
    rows, base = [], [[rng.choice(vocab) for _ in range(n)] for n in (60, 80, 200)]
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "ÄB äB x"), (206, "ÄB ÄB x"), (207, "a b c d e")]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute_print(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == brute_components(want)


def test_large_buckets_find_the_same_components(spark, monkeypatch):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [simhash._signed(p) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")

    def groups():
        found = {r.node: r.component for r in connected_components(simhash.links(frame)).collect()}
        return {p: found.get(p, p) for p in signed}

    few = groups()
    monkeypatch.setattr(simhash, "SMALL", 1)
    assert groups() == few
    want = brute_components({p: p & (2**64 - 1) for p in signed})
    assert few == want


def test_components_of_chain_and_empty(spark):
    chain = spark.range(40).selectExpr("id + 1 as u", "id as v")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(empty).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, 5), (1, "a b c", 9, 5), (None, "a b c", 9, 5)], "doc_id long, text string, fp int, component_id int")
    assert [r.component_id for r in simhash.components(docs).collect()] == [1, 1, 1]


def test_local_stars_reach_all():
    values = np.array([0, 1, 3, 7, 255 << 20], np.int64)
    u, v = simhash.local_stars(values, 1)
    assert dict(zip(u.tolist(), v.tolist())) == {1: 0, 3: 0, 7: 0}


def test_the_query_and_a_long_text(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(250_000))
    rows = [(5, "a b c d"), (3, "A B  C D"), (7, long), (9, long + " end"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = simhash.op10(spark, str(tmp_path))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()}
    want = {i: brute_print(t) for i, t in rows}
    assert got == {i: (f"{want[i]:016x}", c) for i, c in brute_components(want).items()}
