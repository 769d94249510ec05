"""The pipeline against a brute-force version of its stages, and its guard."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

import __spark_entry__
import corpus_pipeline
from strandline.llm import decontaminate as dec
from strandline.llm import packing, quality
from strandline.llm._shared import shared_dir, written

WORDS = ["river", "stone", "cloud", "été", "walk", "under", "seven", "light", "green", "house", "tree", "north", "paper", "glass"]


def make_rows():
    rng = random.Random(15)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "al", "ly"]) + rng.choice(["", "", "a", "er", "on"]) for _ in range(n))
    items = [(i, text(30)) for i in range(3)]
    passage = text(60)
    rows = []
    for i in range(60):
        t = text(rng.randrange(90, 160))
        if i % 10 == 3:
            t += "\n" + items[i % 3][1].upper()
        if i % 7 == 2:
            t = t[:100] + passage + t[100:]
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    for i in range(60, 75):
        words = rows[i - 60][1].split(" ")
        if i % 2:
            words[5] = "changed"
        rows.append((i, " ".join(words), "en", "s0", 0))
    rows += [(80, None, None, None, None), (81, "too short", "en", "s", 9), (82, "junk " * 200, "en", "s", 1000), (83, "#$% &*| <> " * 90, "fr", "s", 990)]
    return rows, items


def brute(rows, items):
    # quality: references and distances counted plainly; English alone has the words that make a reference
    counts, classes, total = Counter(), np.zeros(quality.N_CLASSES), 0
    for _, t, lang, *_ in rows:
        data = (t if lang == "en" else "").encode()
        counts.update(quality.plain_words(data))
        classes += np.bincount(quality.CLASS[np.frombuffer(data, np.uint8)], minlength=quality.N_CLASSES)
    total = counts.total()
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality.Rules.common_words]]
    shares = np.array([0.0] + [counts[w] / total for w in top] + [0.0] * (quality.Rules.common_words - len(top)))
    shares[0] = 1 - shares.sum()
    classes[0] = 0
    rules, kept = quality.Rules(), []
    for row in rows:
        t = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        if len(words) < 50 or 100 * len(inside) > 50 * len(words):
            continue
        hist = np.bincount(quality.CLASS[np.frombuffer(t.encode(), np.uint8)], minlength=quality.N_CLASSES).astype(float)
        hist[0] = 0
        chars = hist.sum() - hist[1]
        mine = Counter(quality.plain_words(t.encode()))
        seen = np.array([0] + [mine[w] for w in top] + [0] * (quality.Rules.common_words - len(top)))
        seen[0] = mine.total() - seen.sum()
        cd, wd = quality.distances(hist[None], classes / classes.sum())[0], quality.distances(seen[None], shares)[0]
        if (chars < rules.class_min_chars or cd <= rules.class_distance + rules.class_noise / chars**0.5) and (len(words) < rules.word_min_words or wd <= rules.word_distance + rules.word_noise / len(words) ** 0.5):
            kept.append(row)
    # near-duplicates: all pairs
    sets = {r[0]: {tuple(r[1].lower().split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in kept}
    top_of = {i: i for i in sets}

    def find(x):
        while top_of[x] != x:
            x = top_of[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                top_of[y] = x
    kept = [r for r in kept if find(r[0]) == r[0]]
    # repeated strings: a set of all windows before
    seen, short = set(), []
    for r in sorted(kept):
        data = r[1].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        left = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        if left.split():
            short.append((r[0], left))
    # benchmark items: exact here, as none is damaged
    return [(i, t) for i, t in short if not any(dec.normal(x) in dec.normal(t) for _, x in items)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(rows, items)
    assert 20 < len(want) < 60
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == columns
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.tokenizer(*packing.default_vocabulary(), packing.default_added()).encode
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert dict(lengths) == {i: len(encode(t)) // 4 + 1 for i, t in want}
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1


def stages(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(folder)), "t")
    return docs


def test_edges(spark, tmp_path):
    """Repeated rows and ids, a null id, ties, a very long text and columns whose names operators use themselves."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "al", "ly"]) + rng.choice(["", "", "a", "er", "on"]) for _ in range(n))
    long, texts = text(150_000), [text(120) for _ in range(6)]
    rows = [(i, t, "en", "s", 0, i, "x") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0, 8, "x"), (2, text(130), "en", "s", 0, 9, "x"), (None, text(140), "en", "s", 0, 10, "x"), (20, texts[3], None, None, None, 11, "x"), (21, long, "en", "s", 0, 12, "x"), (22, None, None, None, None, 13, None), (23, "", None, None, None, 14, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc int, bucket string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = stages(spark, tmp_path)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "bucket"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text[:300]) for r in left.collect())
    want = sorted((i is not None, i or 0, t[:300]) for i, t, *_ in rows[:6] + [rows[7], rows[8], rows[10]])
    assert got == want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.filter("doc_id = 21").count() > 100 and packed.select("doc_id").distinct().count() == 8


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_result_is_left_behind(spark, tmp_path):
    rows, items = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = Path(shared_dir(spark)) / "strandline"
    before = set(folder.iterdir()) if folder.exists() else set()
    found = corpus_pipeline.run(spark, str(tmp_path))
    made = set(folder.iterdir()) - before
    assert len(made) == 1 and found.count() > 0


def test_every_query_of_the_subpackage_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert "pipeline" not in __spark_entry__.oracle_sql() or corpus_pipeline.ORACLE_SQL
