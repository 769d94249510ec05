import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from strandline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def make_rows():
    rng = random.Random(6)
    vocab = ["the", "of", "and", "Été", "house", "tree", "river", " x", "walk", "ends.\nNew", "10", "fine,"]
    weight = [12, 8, 6, 1, 2, 2, 2, 1, 2, 2, 1, 2]
    good = lambda n: " ".join(a + b for a, b in zip(rng.choices(vocab, weight, k=n), rng.choices(["", "s", "ing", "al", "est", "er"], k=n)))
    rows = [(i, good(rng.randrange(60, 400)), "en" if i % 3 else "fr") for i in range(80)]
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t", "en"), (103, "a b c " * 40, "en"), (104, "line one\nline one\n\n \nline one", "en"), (105, "x | y & z\r\n" * 3, None), (106, "x", "en"), (107, good(20_000), "en")]
    rows += [(200, " ".join("#%%&" + str(rng.random())[2:7] + "!!" for _ in range(200)), "en"), (201, " ".join(f"ZQ{rng.randrange(10**6)}X!!" for _ in range(300)), "en")]
    return rows


def test_base_counts_and_verdict(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        assert not (r.base_failed and r.kept)
    assert not got[200].kept and not got[201].kept
    # clean prose stays unless it repeats itself
    assert all(got[i].kept or got[i].base_failed for i, *_ in rows[:80]) and got[107].class_distance < 0.1


def test_references_count_all_words(spark):
    rows = [(i, t, None) for i, t, _ in make_rows()]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), quality.Rules(common_words=3))
    words = Counter(w for _, t, _ in rows for w in quality.plain_words((t or "").encode()))
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert refs.words == [[w for w, _ in top]] and refs.n_words.tolist() == [words.total()]
    assert np.allclose(refs.shares[0, 1:], [n / words.total() for _, n in top])


def test_common_words_table_gives_the_distances():
    rng = random.Random(2)
    vocab = [f"w{i}".encode() for i in range(30)]
    words = [rng.sample(vocab, 8) for _ in range(5)]
    shares = np.array([np.r_[0.4, np.full(8, 0.075)] for _ in words])
    refs = quality.References(np.ones((6, 9)) / 9, words, shares, np.ones(5), np.ones(5), list("abcde"))
    counts = [Counter(rng.choices(vocab, k=rng.randrange(1, 60))) for _ in range(20)] + [Counter()]
    got = quality.CommonWords(refs).distances(counts)
    for k in range(5):
        rows = np.array([[sum(n for w, n in c.items() if w not in words[k]), *(c[w] for w in words[k])] for c in counts])
        assert np.allclose(got[k], quality.distances(rows, shares[k]))


def test_thousands_of_languages(spark):
    """Any number of values of lang gives a verdict: the largest have references, the others one together, as counted anew."""
    rng = random.Random(4)
    stems = "the of and to in house tree river walk light".split()
    text = lambda n: " ".join(w + rng.choice(["", "s", "ing"]) for w in rng.choices(stems, range(10, 0, -1), k=n))
    rows = [(i, text(60 + i % 50), f"l{i:04d}") for i in range(2100)] + [(5000 + i, text(100), "l0003") for i in range(5)] + [(6000, " ".join(f"ZQ{rng.randrange(10**6)}X!!" for _ in range(300)), "l0007")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = quality.Rules(most_references=3)
    refs = quality.references(docs, rules)
    sizes = Counter()
    for _, t, lang in rows:
        sizes[lang] += len(quality.plain_words(t.encode()))
    top = sorted(sizes, key=lambda x: (-sizes[x], x))[:3]
    assert refs.n_words.tolist() == [sizes[x] for x in sorted(top)] + [sum(n for x, n in sizes.items() if x not in top)]
    rest = Counter(w for _, t, lang in rows if lang not in top for w in quality.plain_words(t.encode()))
    assert refs.words[3] == [w for w, _ in sorted(rest.items(), key=lambda x: (-x[1], x[0]))[:100]]
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows) and sum(r.kept for r in got.values()) > 0.9 * sum(not r.base_failed for r in got.values())


def test_many_short_documents_and_references_are_quick():
    rng = random.Random(5)
    words = [[f"w{rng.randrange(5000)}".encode() for _ in range(100)] for _ in range(300)]
    refs = quality.References(np.ones((301, 9)) / 9, words, np.full((300, 101), 1 / 101), np.full(300, 9000), np.full(300, 50_000), [str(i) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["one two three"] * 10_000), pa.array([str(i % 400) for i in range(10_000)])], ["doc_id", "text", "lang"])
    began = time.perf_counter()
    assert sum(b.num_rows for b in quality._judge(refs, quality.Rules())([batch])) == 10_000
    assert time.perf_counter() - began < 5


def test_distance_is_jensen_shannon():
    p, q = np.array([[3, 1, 0]]), np.array([[0.25, 0.25, 0.5]])
    a, b = p[0] / 4, q[0]
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert abs(quality.distances(p, q)[0] - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12
    assert quality.distances(np.zeros((1, 3)), q)[0] == 0


def test_verdicts_against_brute_force(spark, tmp_path):
    """References, distances and verdicts counted anew from the definition, two languages with references of their own."""
    rng = random.Random(12)
    stems = {"en": "the of and to in house tree river walk light".split(), "de": "der die und das nicht haus baum fluss weg licht".split()}
    prose = lambda lang, n: " ".join(w + rng.choice(["", "", "s", "en", "er", "ly", "st", "il"]) + rng.choice(["", "", ".", ","]) for w in rng.choices(stems[lang], range(10, 0, -1), k=n))
    rows = [(i, prose(lang, rng.randrange(20, 300)), lang) for i, lang in enumerate(["en", "de"] * 45)]
    rows += [(100 + i, " ".join(f"{rng.choice('#*&|')}{rng.randrange(10**rng.randrange(1, 7))}" for _ in range(rng.randrange(60, 200))), rng.choice(["en", "de", None])) for i in range(15)]
    rows += [(200 + i, prose("en", 60) + " " + " ".join(f"Q{rng.randrange(10**5)}" for _ in range(20 * i)), "en") for i in range(12)]
    rules = quality.Rules()
    kind = lambda ch: "space" if ch in " \t\n\x0b\x0c\r" else "lower" if "a" <= ch <= "z" else "upper" if "A" <= ch <= "Z" else "digit" if ch in "0123456789" else "stop" if ch in ".,;:!?\"'()" else "symbol" if ch in "#*$%&|<>" else "wide" if ord(ch) > 127 else "other"
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(ch for ch in t if kind(ch) != "stop").lower()) if w]

    def distance(p, q):
        p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p | q}
        side = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v)
        return math.sqrt(max(0, (side(p) + side(q)) / 2))

    refs, corpus = [], Counter(kind(ch) for _, t, _ in rows for ch in t)
    for lang in ("de", "en"):
        classes, seen = Counter(), Counter()
        for _, t, x in rows:
            if x == lang:
                classes.update(map(kind, t))
                seen.update(words(t))
        assert seen.total() >= rules.reference_words
        top = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]]
        shares = Counter({w: seen[w] for w in top})
        shares[""] = seen.total() - shares.total()
        refs.append((classes, shares))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = quality.op4(spark, str(tmp_path))
    assert found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got, verdicts = {r.doc_id: r for r in found.collect()}, Counter()
    for i, t, _ in rows:
        n, failed = len(re.findall(r"[^\x20\x09-\x0D]+", t)), brute(t)[5]
        classes, mine = Counter(map(kind, t)), words(t)
        by = []
        for ref_classes, ref_words in refs:
            known = Counter(w if w in ref_words else "" for w in mine)
            by.append((distance(known, ref_words) if n >= rules.word_min_words else 0, min(distance(classes, ref_classes), distance(classes, corpus))))
        chars = sum(v for k, v in classes.items() if k != "space")
        near = [x for x in by if (chars < rules.class_min_chars or x[1] <= rules.class_distance + rules.class_noise / chars**0.5) and (n < rules.word_min_words or x[0] <= rules.word_distance + rules.word_noise / n**0.5)]
        word_d, class_d = min(near or by)
        kept = not failed and bool(near)
        assert got[i].kept == kept and abs(got[i].class_distance - class_d) < 1e-9 and abs(got[i].word_distance - word_d) < 1e-9, i
        verdicts[kept, failed] += 1
    assert all(verdicts[x] > 3 for x in ((True, False), (False, True), (False, False))), verdicts


def test_empty_and_repeated(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert quality.judge(spark.createDataFrame([(1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string")).count() == 2


def test_rare_language_of_a_large_table(spark):
    """Clean documents of a language with few words stay; noise under its name goes, and noise stays noise elsewhere."""
    rng = random.Random(9)

    def prose(stems, ends, n):
        return " ".join(a + b for a, b in zip(rng.choices(stems, range(len(stems), 0, -1), k=n), rng.choices(ends, k=n)))

    common = "the of and to in is that for it with as was on be by at".split()
    rare = "der die und das nicht von sie ist des sich mit dem dass er es ein".split()
    rows = [(i, prose(common, ["", "s", "ing", "er"], 400), "en") for i in range(60)]
    rows += [(100 + i, prose(rare, ["", "en", "lich", "ung"], 150), "de") for i in range(12)]
    noise = [" ".join(f"ZQ{rng.randrange(10**6)}X!!" for _ in range(300)) for _ in range(3)]
    rows += [(200, noise[0], "de"), (201, noise[1], "en"), (202, noise[2], "xx"), (203, rows[60][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [i for i in range(100, 112) if not got[i].kept and not got[i].base_failed] == []
    assert sum(got[i].kept for i in range(100, 112)) > 5 and got[203].kept == got[100].kept
    assert not got[200].kept and not got[201].kept
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i in got if got[i].kept}
