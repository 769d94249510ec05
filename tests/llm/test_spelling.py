import random
import re
import zlib

import pytest

from strandline.llm import spelling

DOCS = "doc_id long, text string"


def brute_words(rows, least=6, occurrences=5, every=199):
    counts = {}
    for ident, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words.get(form[w])))
    return rows


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: 1 + int(40 * rng.random() ** 3)])
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÉ÷") + w[at:], w[:at] + rng.choice("abc") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "Ā"]).join(words)))
    chain = [(w, 6**k) for k, w in enumerate(("zzyyyyy", "zzxyyyy", "zzxwyyy", "zzxwvyy", "zzxwvuy"), 1)]  # each the form of the one before
    return rows + [(1000 + i, f"{w} " * 6) for w, n in chain for i in range(n // 6)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    rows = made(seed)
    words = brute_words(rows)
    want = brute(words)
    assert len(want) > 80 and sum(r[1] is not None for r in want) > 20 and any(r[1] and r[1] != r[2] for r in want)
    assert got(spelling.variants(spark.createDataFrame(rows, DOCS))) == want


def test_query_matches_brute_force(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    found = got(spelling.op11(spark, root))
    assert {(r[0], r[3]) for r in found} == set(words.items())
    rng = random.Random(3)
    for word, form, _, n, n_near, form_n in rng.sample(sorted(found, key=str), 150):
        others = [x for size in (-1, 0, 1) for x in by_length.get(len(word) + size, []) if near(word, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        assert n_near == len(others) and form == (best if best and words[best] >= 5 * n else None) and form_n == words.get(form)


def test_keys_of_a_word():
    keys = {}
    for word in ("banana", "bonana", "banan", "bannana", "banaña", "anana"):
        for key in spelling.word_keys(word):
            keys.setdefault((key[:2], key[3]), []).append((word, key[2]))
    groups = [sorted(v) for v in keys.values() if len(v) > 1]
    assert [("banana", 0), ("banaña", 0)] in groups and [("banana", 0), ("bonana", 0)] in groups
    assert [("banana", 2), ("bannana", 1)] in groups and [("banan", 2), ("banana", 1)] in groups and [("anana", 2), ("banana", 1)] in groups
    assert len([k for k in spelling.word_keys("aaaaaa") if k[2] == 1]) == 1


def test_nulls_repeats_long_words_and_clashing_names(spark):
    long = "ab" * 20_000
    rows = [(None, "Éabcdef\nabcdefg " + long, "x", 1)] * 6 + [(7, None, None, 2), (8, "", "y", 3), (9, (long + "a ") * 5, "z", 4), (10, "abcdefg " * 30, "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, rank int")
    plain = [r[:2] for r in rows]
    words = brute_words(plain)
    found = got(spelling.variants(docs))
    assert {(r[0], r[3]) for r in found} == set(words.items())
    assert {r[0]: r[4] for r in found}[long] == 1 and (long in words and long + "a" in words)
    assert got(spelling.variants(docs.limit(0))) == set()
    assert got(spelling.variants(docs.filter("text = ''"))) == set()


def test_a_word_of_a_million_letters_makes_short_keys():
    word = "a" * 300_000
    n = sum(1 for _ in spelling.word_keys(word))
    assert n == 300_002
