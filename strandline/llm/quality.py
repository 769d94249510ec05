"""Quality rules by distribution divergence.

References come from the corpus: for each language the histogram of character classes over all of its documents and
its commonest words with their shares. A document is compared with every reference by Jensen-Shannon distance (base 2,
square root, so 0 to 1) and kept if it is near one of them by classes and by words. A histogram of few draws is far from anything by chance, so each
comparison has a minimum length; below it the document passes that comparison.

The languages of the most words give a reference each, all others one together, so any number of values of the language
column gives a result. A reference of few words is a draw itself: the fewer it has, the more it tolerates in documents
of its own language and the less in others, by one rule for every size; and as a histogram of few documents follows whatever noise is among them, by classes a document may be
near the whole corpus instead, whatever the reference. The common words of all references are one table, so work grows with a document's words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import row_chunks, scratch, utf8, written

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?\"'()"
#: Classes of a character, told by its first byte: continuation byte (not counted), space, lower, upper, digit,
#: stop, symbol, other ASCII, beyond ASCII.
N_CLASSES = 9
CLASS = np.full(256, 7, np.int64)
CLASS[0x80:0xC0] = 0
CLASS[0xC0:] = 8
for _i in range(26):
    CLASS[97 + _i], CLASS[65 + _i] = 2, 3
for _chars, _c in ((SPACES, 1), (b"0123456789", 4), (STOPS, 5), (SYMBOLS, 6)):
    CLASS[list(_chars)] = _c


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdict. ``most_references`` languages give a reference of their own.

    A distance may reach its base plus what chance adds, which falls with the root of the document's length. A reference
    of n words, fewer than ``reference_words``, adds chance by its own length for documents of its language; for others
    what they may reach is less by the factor sqrt(n / ``reference_words``), so that a few documents vouch for none but
    their likes.
    """

    common_words: int = 100
    reference_words: int = 5000
    class_distance: float = 0.14
    class_noise: float = 2.2
    class_min_chars: int = 200
    word_distance: float = 0.34
    word_noise: float = 1.2
    word_min_words: int = 80
    most_references: int = 64


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without stops, for the common-word histogram."""
    return text.lower().translate(None, STOPS).split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    starts = np.union1d(order[1:][same], order[:-1][same])
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + 3, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def class_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Histogram of character classes of each document, one row each."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    return np.bincount(row * N_CLASSES + CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def distances(counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a reference (shares); 0 for empty rows."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.minimum(np.sqrt(np.maximum(0, (left + right) / 2)), 1), 0)


def _count(batches):
    """(lang, text) -> (lang, word or null, cls, n): class and word counts of what this task has read."""
    words: dict = {}
    classes: dict = {}

    def rows():
        for lang, counter in words.items():
            keys = list(counter)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(np.full(len(keys), -1, np.int32)), pa.array(list(counter.values()), pa.int64())], ["lang", "word", "cls", "n"]
            )
        for lang, hist in classes.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * N_CLASSES, pa.string()), pa.array([None] * N_CLASSES, pa.binary()), pa.array(np.arange(N_CLASSES, dtype=np.int32)), pa.array(hist, pa.int64())], ["lang", "word", "cls", "n"]
            )

    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offs = utf8(batch.column(1))
        for a, b in row_chunks(offs):
            part = data[offs[a] : offs[b]]
            hist = class_counts(part, offs[a : b + 1] - offs[a])
            raw = part.tobytes()
            for i in range(a, b):
                lang = langs[i]
                words.setdefault(lang, Counter()).update(plain_words(raw[offs[i] - offs[a] : offs[i + 1] - offs[a]]))
                classes[lang] = classes.get(lang, 0) + hist[i - a]
        if sum(map(len, words.values())) > 200_000 or len(classes) > 20_000:
            yield from rows()
            words, classes = {}, {}
    yield from rows()


@dataclass(frozen=True)
class References:
    """Shares of classes (one row each, then the whole corpus), common words, their shares after that of all other words,
    words and characters."""

    classes: np.ndarray
    words: list[list[bytes]]
    shares: np.ndarray
    n_words: np.ndarray
    n_chars: np.ndarray
    #: The language of each, None for all the others together.
    names: list[str | None]

    def own(self, langs: list[str | None]) -> np.ndarray:
        """References x documents: which is that of the document's language. Without any language one is everybody's."""
        at = {name: k for k, name in enumerate(self.names)}
        out = np.zeros((len(self.names), len(langs)), bool)
        for i, lang in enumerate(langs):
            k = at.get(lang, at.get(None)) if lang is not None else 0 if self.names == [None] else None
            if k is not None:
                out[k, i] = True
        return out


def references(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> References:
    """Class and common-word shares of the languages over all documents: one for each of the ``most_references``
    languages of the most words (of equals the first in the alphabet), one for all the others together.

    Every word is counted; each task adds up its own words before the shuffle. Only the commonest words of each
    reference come to the driver. Without any language the whole corpus is the reference; texts without a language count
    for that alone. Null texts count for nothing; repeated rows count each.
    """
    with scratch(docs.sparkSession):
        return _references(docs, rules, lang_col, text_col)


def _references(docs: DataFrame, rules: Rules, lang_col: str, text_col: str) -> References:
    counted = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, word binary, cls int, n long")
    counts = written(counted.groupBy("lang", "word", "cls").agg(F.sum("n").alias("n")), "quality-counts")
    words = counts.filter("word is not null")
    sizes = words.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    kept = sorted(r.lang for r in sizes.orderBy(F.desc("n"), "lang").limit(rules.most_references).collect())
    own = F.coalesce(F.col("lang").isin(kept), F.lit(False))
    # the reference that a row counts for: one of the kept, "" for the others, or none
    ref = F.when(own, F.concat(F.lit("="), "lang")).when(F.col("lang").isNotNull() if kept else F.lit(True), "")
    of = counts.withColumn("ref", ref).filter("ref is not null").groupBy("ref", "word", "cls").agg(F.sum("n").alias("n"))
    hist = defaultdict(lambda: np.zeros(N_CLASSES, np.int64))
    for r in of.filter("word is null").collect():  # N_CLASSES rows for each reference
        hist[r.ref][r.cls] = r.n
    found = of.filter("word is not null")
    totals = {r.ref: r.n for r in found.groupBy("ref").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), "word"))
    common = defaultdict(list)
    for r in sorted(found.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words).collect(), key=lambda r: r["rank"]):
        common[r.ref].append(r)
    names = sorted(totals, key=lambda x: (x == "", x)) or [""]

    def shares_of(name):
        found = [r.n / max(1, totals.get(name, 0)) for r in common[name]]
        return np.r_[1 - sum(found), found, np.zeros(rules.common_words - len(found))]

    for r in counts.filter("word is null").groupBy("cls").agg(F.sum("n").alias("n")).collect():
        hist[None][r.cls] = r.n  # the whole corpus

    def classes_of(name):
        counts = hist[name].astype(float)
        counts[0] = 0  # continuation bytes
        return counts / max(counts.sum(), 1)

    return References(
        np.array([classes_of(x) for x in [*names, None]]), [[bytes(r.word) for r in common[x]] for x in names], np.array([shares_of(x) for x in names]),
        np.array([totals.get(x, 0) for x in names]), np.array([int(hist[x][2:].sum()) for x in names]), [x[1:] or None for x in names],
    )


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
#: Documents that are compared at once.
ROWS = 1024


def _term(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a value of share p here and q there adds to twice the squared distance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)


class CommonWords:
    """Word -> the references that have it among their common words, with its share there."""

    def __init__(self, refs: References):
        self.table: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, words in enumerate(refs.words):
            for w, share in zip(words, refs.shares[k, 1:].tolist()):
                self.table[w].append((k, share))
        self.rest = refs.shares[:, 0]

    def distances(self, counts: list[Counter]) -> np.ndarray:
        """References x documents. A common word that a document lacks adds its share, so only words that it has are looked up."""
        n_refs, n_docs = len(self.rest), len(counts)
        at, p, q = [], [], []
        for i, counter in enumerate(counts):
            total = max(1, counter.total())
            for w in counter.keys() & self.table.keys():
                share = counter[w] / total
                for k, of in self.table[w]:
                    at.append(k * n_docs + i)
                    p.append(share)
                    q.append(of)
        at, p, q = np.array(at, np.int64), np.array(p, float), np.array(q, float)

        def summed(x):
            return np.bincount(at, x, n_refs * n_docs).reshape(n_refs, n_docs)

        own = np.array([c.total() for c in counts]) > 0
        missed = np.maximum(0, (1 - self.rest)[:, None] - summed(q))
        twice = summed(_term(p, q)) + _term(np.maximum(0, own[None] - summed(p)), np.broadcast_to(self.rest[:, None], (n_refs, n_docs))) + missed
        return np.where(own[None], np.minimum(np.sqrt(np.maximum(0, twice / 2)), 1), 0)


def _judge(refs: References, rules: Rules):
    weight = np.minimum(1.0, np.sqrt(refs.n_words / rules.reference_words))[:, None]
    lack = 1 - weight[:, 0]
    class_more = (rules.class_noise * lack / np.sqrt(np.maximum(1, refs.n_chars)))[:, None]
    word_more = (rules.word_noise * lack / np.sqrt(np.maximum(1, refs.n_words)))[:, None]

    def run(batches):
        common = CommonWords(refs)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            langs, parts = batch.column(2).to_pylist(), []
            for a, b in ((x, min(x + ROWS, end)) for start, end in row_chunks(offs) for x in range(start, end, ROWS)):
                part = data[offs[a] : offs[b]]
                local = offs[a : b + 1] - offs[a]
                hist = class_counts(part, local)
                raw = part.tobytes()
                base, long, counters = np.zeros((b - a, 3), np.int64), [], []
                for i in range(b - a):
                    text = raw[local[i] : local[i + 1]]
                    words = text.split()
                    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
                    base[i] = len(words), len(lines) - len(set(lines)), repeated_words(words)
                    if len(words) >= rules.word_min_words:
                        long.append(i)
                        counters.append(Counter(plain_words(text)))
                hist[:, 0] = 0
                chars = hist.sum(1) - hist[:, 1]
                word_d = np.zeros((len(refs.words), b - a))
                if long:
                    word_d[:, long] = common.distances(counters)
                class_d = np.array([distances(hist, c) for c in refs.classes])
                class_d = np.minimum(class_d[:-1], class_d[-1])
                failed = (base[:, 0] < 50) | (100 * base[:, 2] > 50 * base[:, 0])
                own = refs.own(langs[a:b])
                class_most = rules.class_distance + rules.class_noise / np.sqrt(np.maximum(chars, 1))
                class_most = np.where(own, class_most + class_more, class_most * weight)
                word_most = rules.word_distance + rules.word_noise / np.sqrt(np.maximum(base[:, 0], 1))
                word_most = np.where(own, word_most + word_more, word_most * weight)
                short = chars < rules.class_min_chars, base[:, 0] < rules.word_min_words
                like = (short[0] | (class_d <= class_most)) & (short[1] | (word_d <= word_most))  # references x documents
                # the distances told are those of the nearest reference that takes the document, or of the nearest one
                far = np.where(short[1], class_d, word_d) + 2 * (like.any(0) & ~like)
                nearest, every = far.argmin(0), np.arange(b - a)
                parts.append((base[:, 0], chars, hist[:, 6], base[:, 1], base[:, 2], failed, ~failed & like.any(0), class_d[nearest, every], word_d[nearest, every]))
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f.split()[0] for f in OUT.split(", "))])

    return run


def judge(docs: DataFrame, rules: Rules = Rules(), refs: References | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_failed, kept and the two distances.

    A null or empty text has no words and fails; repeated rows and rows with a null id are judged each; a null language
    is not learned from but judged like any other. Of equally near references the first in the alphabet counts. A text of
    any length is judged whole by one task. Any number of languages gives a result: ``most_references`` and one
    references are held, of ``common_words`` words each, and a document is compared with all of them by classes and by
    the common words that it has. An empty table gives an empty result; other columns are not read, so their
    names can't clash.
    """
    refs = refs or references(docs, rules, lang_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_judge(refs, rules), f"doc_id {kind}, {OUT}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all of their columns, that the rules keep; nothing is shuffled but word counts.

    Null, empty and repeated rows, long texts and names of other columns are as in ``judge``; an empty table stays empty.
    """
    run = _judge(references(docs, rules, lang_col, text_col), rules)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches):
        for batch in batches:
            row = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at), batch.column(lang_at)], ["doc_id", "text", "lang"])
            for judged in run([row]):
                yield batch.filter(judged.column("kept"))

    return docs.mapInArrow(keep, docs.schema)


def op4(spark, root):
    """Query op4_quality_rules: base counts and the verdict on each document."""
    return judge(spark.read.parquet(f"{root}/documents.parquet"))
