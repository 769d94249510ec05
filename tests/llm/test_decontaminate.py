import random

import pytest

from strandline.llm import decontaminate as dec


def edit_search(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_edit_distance():
    rng = random.Random(9)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 90)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 120)))
        assert dec.myers(item, text)[0] == edit_search(item, text)


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("qxz")
        elif kind == 1:
            chars.insert(at, rng.choice("qxz"))
        else:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("block", [4 << 20, 400])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    rng = random.Random(10)
    words = ["tree", "river", "stone", "é", "cloud", "walks", "under", "seven"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(15)] + [(20, None), (21, " .,; "), (22, "Same Item text that is twice in here"), (23, "same item text, that is twice in here!")]
    docs = [(0, None, 1), (1, "", 1), (2, "tree " * 4000, 1), (3, "Same item text that is twice in here", 1), (3, "Same item text that is twice in here", 1)]
    for i in range(60):
        _, item = items[i % 15]
        docs.append((10 + i, text(20) + "\n" + damaged(rng, item, rng.randrange(0, 8)).upper() + "! " + text(20), 1))
    want = set()
    for i, t, _ in docs:
        for j, x in items:
            a, b = dec.normal(x), dec.normal(t)
            if a and (d := edit_search(a, b)) <= (len(a) - 2) // 25:
                want.add((i, j, d))
    got = dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want
    assert sum(r.doc_id == 3 for r in got) == 2 * len({w for w in want if w[0] == 3})


def test_short_items_match_whole_words_only(spark):
    docs = spark.createDataFrame([(1, "The inside of the cabin 1220 22 2"), (2, "He went in. Then 2+2 made four"), (3, "IN")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "In"), (2, "2+2"), (3, "a cabin"), (4, "22")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in dec.find_leaks(docs, items).collect()) == [(1, 4, 0), (2, 1, 0), (2, 2, 0), (3, 1, 0)]
    assert sorted((r.doc_id, r.item_id) for r in dec.find_leaks(docs, items, least_bytes=5).collect()) == [(2, 2)]
    assert dec.keep_clean(docs, items).count() == 3 and {r.doc_id for r in dec.keep_clean(docs, items, least_bytes=0).collect()} == set()


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_keep_clean_keeps_all_others(spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    items = [(i, f"benchmark item number {i} with some {'long ' * i}text of its own") for i in range(6)]
    rows = [(i, f"before {items[i % 6][1].upper()} after" if i % 3 == 0 else f"plain text {i}", "x") for i in range(30)] + [(None, None, "y"), (None, "", "y"), (40, "a " * 400_000 + items[2][1], "z"), (1, "plain text 1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string").repartition(3)
    got = dec.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [r for i, r in enumerate(rows) if i >= 30 and r[0] != 40 or i < 30 and i % 3]
    key = lambda r: (r[0] or -1, r[1] is None, r[1] or "", r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "so ask: what is the name of the river?"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "What is the name of the rivers")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(r) for r in dec.op7(spark, str(tmp_path)).select("doc_id", "item_id", "distance").collect()] == [(1, 7, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dec.find_leaks(docs, items).count() == 0
    assert dec.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
