import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import packing

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab c'sd  \n\t1.é,ß#  x日")), max_size=40))
def test_ids_equal_the_json_vocabulary(text):
    got = np.frombuffer(packing.tokenizer(*packing.default_vocabulary(), packing.default_added()).encode(text), "<u4").tolist()
    assert got == REFERENCE.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark):
    rng = random.Random(11)
    words = ["the", "river", "naïve", "don't", "x1", "end.\nNew", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900))), 1) for i in range(150)]
    rows += [(200, None, 1), (201, "", 1), (202, "  a  ", 1), (203, "tree " * 5000, 1), (0, rows[0][1], 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(packing.token_pieces(docs, added=packing.default_added())).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text, _ in rows:
        ids = np.array(REFERENCE.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)[:: 2 if i == 0 else 1]
        assert sum(p.length for p in parts) == len(ids)
        assert all(p.length == 1024 for p in parts[1:]) and [p.piece for p in parts] == list(range(len(parts)))
        for p in parts:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 2
    ids = packing.token_pieces(spark.createDataFrame(rows[:3], "doc_id long, text string, offset int"), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


def count(plan):
    return sum(n for n, _ in plan)


def test_plan_uses_each_piece_once_and_comes_near_the_bound():
    rng = np.random.default_rng(0)
    draws = [(rng.integers(1, 1025, 40_000), 1.006), (rng.geometric(1 / 200, 40_000).clip(1, 1024), 1.006), (rng.integers(300, 700, 3000), 1.06), (np.full(100, 700), 1.5)]
    for draw, near in draws:
        histogram = np.bincount(draw, minlength=1025)
        plan = packing.make_plan(histogram)
        used = np.zeros(1025, int)
        for n, parts in plan:
            assert sum(length * k for length, k in parts) <= 1024 and n > 0
            for length, k in parts:
                used[length] += n * k
        assert (used == histogram).all()
        assert count(plan) <= near * draw.sum() / 1024 + 1 and count(plan) <= 1.004 * count(packing.best_fit(histogram, 1024)) + 1
    small = packing.make_plan(np.bincount([6, 4, 5, 5, 3, 7, 10], minlength=11), 10)
    assert count(small) == 4


def test_fitted_patterns_carry_the_plan():
    """With many pieces of each length most sequences are repeats of fitted patterns, and hardly a token is lost."""
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(40, 900, 400_000), minlength=1025)
    patterns = packing.length_patterns(np.flatnonzero(histogram), 1024)
    fitted = packing.fit_repeats(patterns, histogram, 1024)
    bound = (histogram * np.arange(1025)).sum() / 1024
    assert 0.97 < fitted.sum() / bound < 1.01 and (fitted > 0).sum() <= 1025
    assert count(packing.make_plan(histogram)) <= 1.002 * bound + 1


def test_patterns_are_filled_as_far_as_lengths_can():
    patterns = packing.length_patterns(np.array([200, 300, 500, 524, 824]), 1024)
    want = {(0, 0, a) for a in (200, 300, 500, 524, 824)} | {(0, 200, 824), (0, 300, 524), (0, 500, 524), (200, 200, 524), (200, 300, 524), (300, 300, 300)}
    assert {tuple(p) for p in patterns.tolist()} == want


def test_least_squares_against_brute_force():
    """The conditions of a least non-negative solution hold: no pattern that is in could be changed for the better, none
    that is out could enter."""
    rng = np.random.default_rng(3)
    for lengths in (np.array([200, 300, 500, 524, 824]), np.unique(rng.integers(1, 100, 25)), np.arange(1, 60)):
        capacity = 1024 if lengths.max() > 100 else 120
        histogram = np.zeros(capacity + 1)
        histogram[lengths] = rng.integers(1, 50, len(lengths))
        patterns = packing.length_patterns(lengths, capacity)
        x = packing.fit_repeats(patterns, histogram, capacity, tolerance=1e-6)
        matrix = np.zeros((capacity + 2, len(patterns)))
        for i, p in enumerate(patterns):
            for n in p[p > 0]:
                matrix[n, i] += 1
            matrix[-1, i] = packing.UNUSED_WEIGHT * (1 - p.sum() / capacity)
        gradient = matrix.T @ (np.r_[histogram, 0] - matrix @ x)
        assert (x >= 0).all() and gradient.max() < 1e-3 and np.abs(gradient[x > 1e-6]).max() < 1e-3


def test_empty(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_added_tokens_get_the_ids_of_the_untouched_json_form(spark, tmp_path):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = ["<|endoftext|>", " ", "a", " river", "<|", "|>", "\n", "é", "endoftext", "  "]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|> ", None, ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by_doc = defaultdict(list)
    for r in packing.op8(spark, str(tmp_path)).collect():
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert sum(n for _, n, _ in by_doc[i]) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in by_doc[i])


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", " \n", "7", "."])
def test_runs_of_two_megabytes(spark, run):
    text = "x" + run * (2_000_000 // len(run)) + "y <|endoftext|> z"
    want = np.array(REFERENCE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.tokenizer(*packing.default_vocabulary(), packing.default_added()).encode(text) == want


def test_a_long_white_space_run_through_spark(spark):
    docs = spark.createDataFrame([(1, "x" + " " * 1_200_000 + "y"), (2, "\n" * 1_200_000)], "doc_id long, text string")
    for row in packing.token_pieces(docs, added=packing.default_added()).groupBy("doc_id").agg({"length": "sum"}).collect():
        text = docs.filter(f"doc_id = {row[0]}").first().text
        assert row[1] == len(REFERENCE.encode(text, add_special_tokens=False).ids) + 1
