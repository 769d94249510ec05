import hashlib
import random

import numpy as np
import pytest

from strandline.llm import chunks
from strandline.llm.suffix import union_of_spans, without_spans


def brute_ends(data, cuts):
    out, at, hashes = [], 0, []
    for i in range(1, len(data) + 1):
        h = 0
        for c in data[max(0, i - 32) : i]:
            h = ((h << 1) + int(chunks.GEAR[c])) & 0xFFFFFFFF
        hashes.append(h)
    r = cuts.reach
    for i in range(1, len(data) + 1):
        around = hashes[max(0, i - 1 - r) : i + r]
        cut = r + 32 <= i <= len(data) - r and hashes[i - 1] == min(around) and hashes[i - 1] not in around[:r]
        if cut or i - at == cuts.longest or i == len(data):
            out.append(i)
            at = i
    return out


def brute(rows, cuts):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data, at, spans = (t or "").encode(), 0, []
        for e in brute_ends(data, cuts):
            if data[at:e] in seen:
                spans.append((at, e))
            seen.add(data[at:e])
            at = e
        spans = [(a, b) for a, b in union_of_spans(spans) if b - a >= cuts.min_run]
        out[i] = (len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without_spans(data, spans)).hexdigest())
    return out


def make_rows():
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    shared = [text(90) for _ in range(3)]
    rows = [(i, text(rng.randrange(60)) + rng.choice(shared) * (i % 2) + text(rng.randrange(60))) for i in range(50)]
    return rows + [(60, rows[1][1]), (61, None), (62, ""), (63, "a" * 2000), (64, "short"), (65, "short"), (66, "x" + rows[3][1])]


@pytest.mark.parametrize("cuts", [chunks.Cuts(), chunks.Cuts(8, 64), chunks.Cuts(16, 256, 100)])
def test_matches_brute_force(spark, cuts):
    rows = make_rows()
    _, got = chunks.dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(4), cuts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute([(i, t or "") for i, t in rows], cuts)


def test_an_insertion_moves_few_cuts():
    rng = random.Random(13)
    data = bytes(rng.randrange(97, 123) for _ in range(20_000))
    more = data[:7000] + b"inserted" + data[7000:]

    def bodies(x):
        ends = chunks.text_chunks(np.frombuffer(x, np.uint8), np.array([0, len(x)]), chunks.Cuts())[0]
        return {x[a:b] for a, b in zip([0, *ends], ends)}

    assert len(bodies(more) - bodies(data)) < 8


def test_empty_null_and_repeated_ids(spark):
    assert chunks.dedup(spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0
    text, other = ("".join(random.Random(k).choices("abcdef ", k=600)) for k in (3, 4))
    rows = [(None, text), (1, text), (1, text), (2, text), (2, other), (3, None), (3, "")]
    got = chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    want = [(None, 600, 0), (1, 600, 600), (1, 600, 600), (2, 600, 600), (2, 600, 0), (3, 0, 0), (3, 0, 0)]
    assert sorted(((r.doc_id or -1, r.n_bytes, r.n_removed) for r in got)) == sorted((i or -1, n, k) for i, n, k in want)


def test_long_texts(spark):
    """Over a megabyte: more than one chunk of rows; the shorter text starts inside of the longer one."""
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(200_000))
    rows = [(0, long), (1, long[300_000:900_000]), (2, "other text " * 3)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert got[0] == (len(long), 0) and got[1][0] == 600_000 and 599_000 < got[1][1] < 600_000


def test_the_query(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = chunks.op6(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute([(i, t or "") for i, t in rows], chunks.Cuts())
