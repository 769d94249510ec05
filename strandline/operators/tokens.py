"""The boundary to model vocabularies: token ids of any tokenizer file, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}

#: Vocabulary file -> (encode: list of texts to lists of ids, decode: ids to text).
Vocabulary = Callable[[str], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[int]], str]]]


def json_vocabulary(path: str):
    """A vocabulary in the JSON form of the ``tokenizers`` library, without special tokens; one for each worker process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    t = _loaded[path]
    return (lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]), (lambda ids: t.decode(ids, skip_special_tokens=False))


def encoded(df: DataFrame, ident: str, text: str, path: str, load: Vocabulary = json_vocabulary) -> DataFrame:
    """(ident, ids): token ids of whole texts; a null text has null ids. Texts are encoded a hundred at a time."""

    def run(batches):
        encode, _ = load(path)
        for batch in batches:
            ids = []
            for at in range(0, batch.num_rows, 100):
                texts = batch.column(1).slice(at, 100).to_pylist()
                found = iter(encode([t for t in texts if t is not None]))
                ids += [None if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [ident, "ids"])

    return df.select(ident, text).mapInArrow(run, f"{ident} {dict(df.dtypes)[ident]}, ids array<int>")


def decoded(df: DataFrame, ident: str, ids: str, path: str, load: Vocabulary = json_vocabulary) -> DataFrame:
    """(ident, text): the texts of token ids."""

    def run(batches):
        _, decode = load(path)
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ident, "text"])

    return df.select(ident, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"{ident} {dict(df.dtypes)[ident]}, text string")


def default_vocabulary() -> str:
    """The installed 50k byte vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
