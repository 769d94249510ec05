"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams (of lower-cased letters, with word ends), learned by
counting over all labelled training documents. A document is a mixture: expectation-maximisation estimates the
proportions of its trigrams that each language explains. Languages enter in the order of the full mixture's
proportions, one at a time, as long as the full mixture's likelihood leaves room for another one to pay, and the set
with the best penalised likelihood (a BIC-like price for each language beyond the first) is kept. The predicted language is the largest proportion of that set and the score is this proportion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import group_starts, row_chunks, utf8

#: Hash buckets of the trigram distributions; a model is languages x BUCKETS numbers.
BUCKETS = 1 << 14
MIX = np.uint32(0x9E3779B1)


#: Runs of anything but letters, digits aside that are no decimals ("½", "²").
NOT_LETTERS = re.compile(r"[\W\d_]+")


@cache
def _numbers() -> dict[int, str]:
    """The word characters that are neither letters (categories L*) nor decimal digits, each to become a blank."""
    return {i: " " for i in range(0x80, 0x110000) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal()}


@cache
def _number_marks() -> frozenset[str]:
    return frozenset(map(chr, _numbers()))


def letters(text: str | None) -> list[str]:
    """Runs of letters of the lower-cased text; the first and the last may be empty."""
    text = (text or "").lower()
    if not text.isascii() and not _number_marks().isdisjoint(text):
        text = text.translate(_numbers())
    return NOT_LETTERS.split(text)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS


@dataclass(frozen=True)
class Settings:
    """``price`` times the log of a document's trigrams is the cost of another language; ``most`` bounds a set (None: all)."""

    rounds: int = 12
    price: float = 2.0
    most: int | None = None
    smoothing: float = 0.5


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of each byte trigram of each text's lower-cased letters."""
    clean = [" ".join(["", *letters(t), ""]).replace("  ", " ").encode() for t in texts]
    clean = [c if len(c) > 2 else b"" for c in clean]
    data = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], ((code[inside] * MIX) >> np.uint32(18)).astype(np.int64)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        _, offs = utf8(batch.column(1))
        for a, b in row_chunks(offs):
            doc, bucket = trigrams(batch.column(1).slice(a, b - a).to_pylist())
            names = langs[a:b]
            for lang in set(names):
                mine = np.array([x == lang for x in names])
                counts[lang] = counts.get(lang, 0) + np.bincount(bucket[mine[doc]], minlength=BUCKETS)
    for lang, hist in counts.items():
        at = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(hist[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> Model:
    """Count trigrams of all rows with a language; only the counts (languages x BUCKETS at most) reach the driver.

    Null texts and rows with a null language count for nothing; repeated rows count each; an empty table gives a model
    without languages.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    hist = np.full((len(languages), BUCKETS), settings.smoothing)
    if languages:
        index = {lang: i for i, lang in enumerate(languages)}
        row = np.array([index[x] for x in counted.column("lang").to_pylist()], int)
        hist[row, counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    return Model(languages, np.log(hist / hist.sum(1, keepdims=True)) if languages else hist)


def _mixture(prob: np.ndarray, weight: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, allowed: np.ndarray, rounds: int):
    """EM over documents side by side: (proportions, log-likelihood) with the languages ``allowed`` to each."""
    share = allowed / allowed.sum(1, keepdims=True)
    ones, tiny = np.ones(prob.shape[1], prob.dtype), np.float32(1e-30)
    for _ in range(rounds):
        joint = prob * share[doc]
        joint *= (weight / np.maximum(joint @ ones, tiny))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    likelihood = np.add.reduceat(weight * np.log(np.maximum((prob * share[doc]) @ ones, tiny)), starts)
    return share, likelihood


def infer(model: Model, texts: list[str | None], settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, score) of each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    doc, bucket = trigrams(texts)
    if not len(doc) or not model.languages:
        return best, score
    key = np.sort(((doc << 14) | bucket).astype(np.uint32 if len(texts) < 1 << 18 else np.uint64))
    cuts = np.flatnonzero(group_starts(key))
    weight, key = np.diff(np.r_[cuts, len(key)]), key[cuts].astype(np.int64)
    doc, bucket = key >> 14, key & (BUCKETS - 1)
    present, starts = np.unique(doc, return_index=True)
    local = np.repeat(np.arange(len(present)), np.diff(np.r_[starts, len(doc)]))
    weight = weight.astype(np.float32)
    total = np.add.reduceat(weight, starts)
    # scaled by each trigram's best language, which no comparison notices
    scaled = model.log_p - model.log_p.max(0)
    table = np.exp(scaled).astype(np.float32).T.copy()
    prob = table[bucket]
    n, k = len(present), len(model.languages)
    single = np.add.reduceat(scaled.astype(np.float32).T[bucket] * weight[:, None], starts, axis=0)
    value, final = single.max(1), np.eye(k, dtype=np.float32)[single.argmax(1)]
    share, likelihood = _mixture(prob, weight, starts, local, total, np.ones((n, k), np.float32), settings.rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    most, here = likelihood, np.arange(n)  # documents that are still open, and their data
    for size in range(2, min(k, settings.most or k) + 1):
        # no set can explain a text better than all languages together: where even that doesn't pay, the set is closed
        still = most - settings.price * (size - 1) * np.log(total) > value[here]
        if not still.any():
            break
        number = np.full(len(here), -1)
        number[still] = np.arange(still.sum())
        mine = number[local] >= 0
        prob, weight, local, total = prob[mine], weight[mine], number[local[mine]], total[still]
        starts, most, here = np.flatnonzero(group_starts(local)), most[still], here[still]
        allowed = np.zeros((len(here), k), np.float32)
        np.put_along_axis(allowed, order[here, :size], 1, 1)
        share, likelihood = _mixture(prob, weight, starts, local, total, allowed, settings.rounds)
        priced = likelihood - settings.price * (size - 1) * np.log(total)
        better = priced > value[here]
        value[here] = np.where(better, priced, value[here])
        final[here[better]] = share[better]
    best[present], score[present] = final.argmax(1), final.max(1)
    return best, np.clip(score, 0, 1)


def _predict(model: Model, settings: Settings):
    names = np.array([*model.languages, "und"], object)

    def run(batches):
        for batch in batches:
            _, offs = utf8(batch.column(1))
            found, scores = [], []
            for a, b in row_chunks(offs, 1 << 18):
                best, score = infer(model, batch.column(1).slice(a, b - a).to_pylist(), settings)
                found.append(names[best])
                scores.append(score)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(found), pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: nothing but the text decides.

    ``und`` with score 0 if a text is null, empty or has no letters (Unicode categories L*), or if nothing was learned.
    Ties go to the language first in the alphabet. Repeated rows and rows with a null id are predicted each; an empty
    table gives an empty result. A text of any length is one mixture, worked on whole by one task. Other columns are not
    read, so their names can't clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model, settings), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op3(spark, root):
    """Query op3_language_id: learn from documents that are not held out, predict all."""
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
