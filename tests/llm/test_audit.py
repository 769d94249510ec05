import itertools
import random
import re

from strandline.llm import audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    least = {}
    for ident, text, _ in rows:
        key = text or ""
        now = (ident is not None, ident or 0)
        least[key] = min(least.get(key, now), now)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = {}
    for ident, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": (ident is not None, ident or 0) > least[text],
        }
        docs.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, ident in good, ident in toxic))
    out = {}
    for part, members in docs.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [m for m in members if f in m[0] and not m[0] & before]
                removed_by[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not m[0] & (before | {f}) for m in members), len(gone), sum(f in m[0] and bool(m[0] & before) for m in members),
                    sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), f,
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v[6] = removed_by[order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in df.collect()}
    return rows


def made(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(150)] + ["ÄÖ", "GmbH", "WORD", "a#b"]
    texts = [" ".join(rng.choice(vocab[: rng.choice((40, 150, 154))]) for _ in range(rng.choice((3, 150, 210, 400)))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(n)]
    rows += [(n + i, texts[0], "en") for i in range(n)]  # half of all rows are copies
    rows += [(None, texts[1], "de"), (None, texts[0], "de"), (None, None, None), (5, texts[2], "en"), (5, texts[2], "en"), (300, "", "fr"), (301, None, "fr"), (302, " \t\n", "fr"), (303, "X" * 300_000, "fr"), (304, "é" * 200_000 + " |", "fr")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 305, 2)] + [(2, 1, 0), (None, 1, 1)]
    return rows, labels


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], DOCS + ", part string, mask int").repartition(3)
    found = got(audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert found == brute(rows, labels)


def test_audit_matches_brute_force(spark):
    check(spark, *made(1))


def test_groups_of_copies_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(audit, "bucket_count", lambda n: 40)
    rows, labels = made(2)
    check(spark, rows, labels)
    copies = [(i // 2, "the same", "en") for i in range(300)]  # repeated ids next to each other, all one text
    check(spark, copies, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert got(audit.audit(docs, labels)) == {}
    rows = [(1, "one", "en"), (2, None, None)]
    assert got(audit.audit(spark.createDataFrame(rows, DOCS), labels)) == brute(rows, [])
