"""Token ids through the boundary: those of the vocabulary's own library, and any other vocabulary."""

import pytest

from strandline.operators import tokens

TEXTS = ["The river runs.", "", None, "naïve café\n\n  x", "a" * 5000 + " b"]


def test_ids_are_those_of_the_vocabulary(spark):
    path = tokens.default_vocabulary()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(2)
    ids = tokens.encoded(df, "id", "text", path)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    want = {i: None if t is None else library.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.id: r.ids for r in ids.collect()} == want
    assert {r.id: r.text for r in tokens.decoded(ids, "id", "ids", path).collect()} == dict(enumerate(TEXTS))
    assert tokens.encoded(df.limit(0), "id", "text", path).collect() == []


def test_another_vocabulary(spark):
    def letters(path):
        return (lambda texts: [[ord(c) for c in t] for t in texts]), (lambda ids: "".join(map(chr, ids)))

    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    ids = tokens.encoded(df, "id", "text", "none", letters)
    assert ids.first().ids == [97, 98, 99] and tokens.decoded(ids, "id", "ids", "none", letters).first().text == "abc"
