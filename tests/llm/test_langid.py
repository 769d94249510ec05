import itertools
import random

import numpy as np

from strandline.llm import langid

SYLLABLES = {"aa": ["la", "mi", "so", "ré", "do"], "bb": ["krz", "tch", "ung", "ßt", "pf"], "cc": ["кот", "да", "нет", "мир"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def make_rows():
    rng = random.Random(7)
    return [(i, text(rng, lang, rng.randrange(3, 120)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]


def test_held_out_accuracy_and_bounds(spark, tmp_path):
    rows = make_rows() + [(900, None, "aa"), (901, "", "aa"), (902, "12 -- ! ½ ² Ⅷ ①", "bb"), (903, "lami soré", None), (904, "KRZUNG TCHPF", "cc"), (None, "кот кот", "cc")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in langid.op3(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:180] if got[i].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, lang in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "aa" and got[904].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_proportions_and_language_set():
    rng = random.Random(8)
    hist = {}
    for lang in SYLLABLES:
        _, bucket = langid.trigrams([text(rng, lang, 3000)])
        hist[lang] = np.bincount(bucket, minlength=langid.BUCKETS) + 0.5
    model = langid.Model(sorted(hist), np.log(np.array([h / h.sum() for _, h in sorted(hist.items())])))
    pure, mixed = text(rng, "bb", 60), text(rng, "aa", 75) + " " + text(rng, "bb", 25)
    best, score = langid.infer(model, [pure, mixed])
    assert model.languages[best[0]] == "bb" and score[0] == 1.0
    # brute force: likelihood on a grid of proportions of the two languages
    _, b = langid.trigrams([mixed])
    p = np.exp(model.log_p[:2, b])
    grid = np.linspace(0.001, 0.999, 999)
    want = grid[np.argmax([np.log(g * p[0] + (1 - g) * p[1]).sum() for g in grid])]
    assert model.languages[best[1]] == ("aa" if want > 0.5 else "bb") and abs(score[1] - max(want, 1 - want)) < 0.02


MANY = {"aa": "lami soré", "bb": "krztch ungßt", "cc": "котдамир", "dd": "αβγδεζη", "ee": "ваншилоб", "ff": "עבריתשל"}


def many_text(rng, lang, n):
    return " ".join("".join(rng.choice(MANY[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_language_sets_against_all_sets():
    """Each set of one to six languages is tried by brute force; the kept proportions are those of the best one."""
    rng = random.Random(4)
    hist = {lang: np.bincount(langid.trigrams([many_text(rng, lang, 3000)])[1], minlength=langid.BUCKETS) + 0.5 for lang in MANY}
    names = sorted(hist)
    model = langid.Model(names, np.log(np.array([hist[x] / hist[x].sum() for x in names])))
    texts = [" ".join(many_text(rng, lang, n) for lang, n in parts) for parts in ([("aa", 40)], [("aa", 50), ("cc", 30)], [("bb", 30), ("dd", 40), ("ff", 20)], [("aa", 40), ("bb", 20), ("cc", 30), ("dd", 25)], [("cc", 3), ("dd", 60)], [(x, 20 + 3 * i) for i, x in enumerate(names)])]
    best, score = langid.infer(model, texts)
    sizes = []
    for i, text in enumerate(texts):
        _, b = langid.trigrams([text])
        p, found = np.exp(model.log_p[:, b] - model.log_p[:, b].max(0)), None
        for n in range(1, 7):
            for chosen in itertools.combinations(range(6), n):
                share = np.full(n, 1 / n)
                for _ in range(langid.Settings.rounds if n > 1 else 0):
                    joint = share[:, None] * p[list(chosen)]
                    share = (joint / joint.sum(0)).sum(1) / len(b)
                value = np.log(share @ p[list(chosen)]).sum() - langid.Settings.price * (n - 1) * np.log(len(b))
                if found is None or value > found[0]:
                    found = value, chosen, share
        sizes.append(len(found[1]))
        assert best[i] == found[1][int(found[2].argmax())] and abs(score[i] - found[2].max()) < 1e-3
    assert sizes[0] == 1 and sizes[3] == 4 and sizes[5] == 6


def test_ties_repeats_and_long_texts(spark):
    rows = [(1, "лами лами", "bb"), (1, "лами лами", "bb"), (2, "лами лами", "aa"), (2, "лами лами", "aa"), (None, None, "aa")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "лами " * 300_000
    got = langid.predict(spark.createDataFrame([(1, "лами"), (1, "лами"), (2, long), (None, "лами")], "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "aa"), (1, "aa"), (1, "aa"), (2, "aa")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).first().lang_pred == "und"
