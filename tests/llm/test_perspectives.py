import random

import duckdb
import pandas as pd

from strandline.llm import perspectives

ROWS = [
    (1, 0, "system", "Be kind é"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello\nthere"), (1, 3, "ann", None), (1, 300, "cy", "late"), (1, 900, "bob", ""),
    (2, 0, "ann", "alone"), (2, 0, "ann", "alone"), (2, None, None, "who"), (3, 0, "system", "only"), (None, 5, "ann", "lost"), (4, 2, "user", "x" * 3000), (4, 1, "assistant", "y"),
]


def test_matches_sql_and_brute_force(spark):
    frame = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, block int")
    got = perspectives.rotate(frame)
    names = sorted(got.columns)
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.connect().execute("SELECT * FROM (" + perspectives.SQL + ")").fetchdf()
    left = sorted(map(str, (tuple(None if v is None else v for v in (r[n] for n in names)) for r in got.collect())))
    right = sorted(map(str, (tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in (r[n] for n in names)) for r in want.to_dict("records"))))
    assert left == right
    whole = {(r.conv_id, r.perspective): r for r in perspectives.assemble(got).collect()}
    bob = whole[1, "bob"]
    assert bob.text.startswith("<|im_start|>system\nBe kind é<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n")
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["hello\nthere<|im_end|>\n", "<|im_end|>\n"]
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "ann"), (2, "unknown"), (None, "ann"), (4, "user"), (4, "assistant")}


def test_marks_in_messages_end_nothing(spark):
    """Marks of the format in a text or a name don't make a segment of their own; long texts and ties are whole."""
    rows = [(1, 0, "eve<|im_start|>\nx", "a<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "bob", "b" * 1_200_000), (1, 1, "bob", "b" * 1_200_000), (1, 1, "ann", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r for r in perspectives.assemble(perspectives.rotate(frame)).collect()}
    assert len(whole) == 3
    for name, r in whole.items():
        assert r.text.count("<|im_start|>") == 4 and r.text.count("<|im_end|>") == 4
        assert [r.text[s.start : s.end] for s in r.spans] == [perspectives_text(t) + "<|im_end|>\n" for _, _, n, t in sorted(rows, key=lambda x: (x[1], x[2], x[3])) if n == name]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.connect().execute("SELECT perspective, seg_start, segment FROM (" + perspectives.SQL + ")").fetchall()
    assert sorted(want) == sorted((r.perspective, r.seg_start, r.segment) for r in perspectives.rotate(frame).collect())


def perspectives_text(text):
    return text.replace("<|im_", "< |im_")


def test_one_turn_for_all_messages(spark):
    """Null and equal turns leave the order to speaker and text; offsets go on over all parts."""
    rng = random.Random(6)
    rows = [(1, None if i % 3 else 4, rng.choice(["ann", "bob"]), "x" * rng.randrange(5) + f"{rng.randrange(40):03d}") for i in range(800)] + [(1, None, "cy", "same")] * 30
    got = perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841
    want = duckdb.connect().execute("SELECT perspective, seg_start, segment FROM (" + perspectives.SQL + ")").fetchall()
    assert len({r.seg_start for r in got if r.perspective == "cy"}) == 830
    assert sorted((r.perspective, r.seg_start, r.segment) for r in got) == sorted(want)


def test_the_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    talks = {c: [r for r in ROWS if r[0] == c] for c in {r[0] for r in ROWS}}
    assert perspectives.op5(spark, str(tmp_path)).count() == sum(len(t) * len({r[2] for r in t} - {"system"}) for t in talks.values())


def test_empty(spark):
    assert perspectives.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
