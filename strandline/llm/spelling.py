"""Spelling variants: words one code point apart, grouped without making pairs.

Two words of one length are near if they agree in a wildcard key (position, what is before it, what is after it). Such
a group keeps its size and its two best words, which is all that a member needs: its near words there are the size less
one, the best of them is the first, or the second for the first itself. A word and a longer one are near if a deletion of
the longer is the word: deletions meet the vocabulary in one group by what is left, where the word gets the count and the
best of the longer ones and each longer one gets the word. So a word of L code points makes at most 2 L + 1 short rows.

What stands before and after a position is told by a polynomial hash modulo 2^127 - 1 together with the length and the
position, so a key has 16 bytes whatever the word's length, and all keys of a word take one pass over it. Two different
strings of L code points agree with a probability of L / 2^127. Words are known by their rank (most occurrences
first, then code-point order): the best of several is the least.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import KEY_ROWS, scratch, utf8, written

MODULUS = (1 << 127) - 1
#: The base of the polynomial hash, and its inverse.
BASE = 0x5DEECE66D1F3A7B9C4E8F02D6B3A9157
INVERSE = pow(BASE, -1, MODULUS)
#: Words and bytes that a task counts before it hands them on.
HELD_WORDS, HELD_BYTES = 1 << 18, 32 << 20
#: Keys of one Arrow batch, and words whose keys one task makes.
KEYS, WORDS = 1 << 16, 1 << 14


def damaged(ident: bytes, run: str, every: int) -> str:
    """The run without one code point, if ``every`` divides the checksum of ``<ident>:<run>``."""
    h = zlib.crc32(run.encode(), zlib.crc32(ident + b":"))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int, every: int | None):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches):
        held, size = Counter(), 0
        for batch in batches:
            idents, (data, offs) = batch.column(0).to_pylist(), utf8(batch.column(1))
            at = offs.tolist()
            for i, ident in enumerate(idents):
                text = data[at[i] : at[i + 1]].tobytes().lower().decode()  # bytes.lower() maps A-Z only
                ident = (ident or "").encode()
                for word, n in Counter(runs.findall(text)).items():
                    if every:
                        word = damaged(ident, word, every)
                    if word not in held:
                        size += len(word)
                    held[word] += n
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield _counted(held)
                    held, size = Counter(), 0
        yield _counted(held)

    return run


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, least: int = 6, every: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all runs of Latin letters, A-Z lower-cased, of ``least`` code points or more.

    With ``every``, one in so many (document, run) loses a code point first, see ``damaged``; a null id counts as an
    empty text there. Tasks add up what they see before anything is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("ident"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_count(least, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") >= least)


def ranked_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``rank`` from 0: most occurrences first, then in code-point order. A written table."""
    with scratch(words.sparkSession) as keep:
        found = written(words, "words")
        parts = max(1, -(-found.count() // KEY_ROWS))
        # ranges are told by the first letters, so that splitters are short; equal ones stay together
        dealt = written(found.repartitionByRange(parts, F.desc("n"), F.substring("word", 1, 64)).withColumn("_part", F.spark_partition_id()), "words-by-range")
        sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
        bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row for each KEY_ROWS words
        place = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("n"), "word"))
        return keep(dealt.withColumn("_place", place).join(F.broadcast(bases), "_part").select("word", "n", (F.col("_base") + F.col("_place") - 1).cast("long").alias("rank")), "ranked-words")


def word_keys(word: str):
    """(length, position, kind, hash): the word itself, its wildcard keys and its different deletions.

    Position is -1 for whole strings. Kind is 0 for a wildcard, 1 for a deletion and 2 for the word.
    """
    codes = [ord(c) for c in word]
    n, power, parts = len(codes), 1, []
    for c in codes:
        parts.append(c * power % MODULUS)
        power = power * BASE % MODULUS
    whole = sum(parts) % MODULUS
    yield n, -1, 2, whole
    before = 0
    for i, part in enumerate(parts):
        yield n, i, 0, (whole - part) % MODULUS
        after = before + part
        if not i or codes[i] != codes[i - 1]:  # deleting any of equal neighbours leaves the same string
            yield n - 1, -1, 1, (before + (whole - after) * INVERSE) % MODULUS
        before = after % MODULUS


def _keys(batches):
    def packed(rows):
        size, at, kind, key, rank = zip(*rows)
        arrays = [pa.array(size, pa.int32()), pa.array(at, pa.int32()), pa.array(kind, pa.int8()), pa.array([k.to_bytes(16, "big") for k in key], pa.binary()), pa.array(rank, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["size", "at", "kind", "key", "rank"])

    rows = []
    for batch in batches:
        for word, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key in word_keys(word):
                rows.append((*key, rank))
                if len(rows) == KEYS:
                    yield packed(rows)
                    rows = []
    if rows:
        yield packed(rows)


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of the words that have near ones; ``words`` is (word, rank). ``best`` is a rank.

    A wildcard group has a member for each letter at most, and a string has a longer one for each letter and place.
    """
    spread = words.select("word", "rank").repartition(max(1, -(-words.count() // WORDS)))
    rows = spread.mapInArrow(_keys, "size int, at int, kind tinyint, key binary, rank long")
    groups = rows.groupBy("size", "at", "key").agg(F.collect_list(F.struct("kind", "rank")).alias("m")).filter("size(m) > 1")

    def member(rank, n, best):
        return F.struct(rank.alias("rank"), n.cast("long").alias("n"), best.alias("best"))

    ranks = F.array_sort(F.transform("m", lambda m: m["rank"]))
    others = (F.size("m") - 1).alias("n")
    wild = F.transform(ranks, lambda r: member(r, others, F.when(r == ranks[0], ranks[1]).otherwise(ranks[0])))
    word = F.filter("m", lambda m: m["kind"] == 2)
    longer = F.transform(F.filter("m", lambda m: m["kind"] == 1), lambda m: m["rank"])
    whole = F.get(word, F.lit(0))["rank"]
    indel = F.concat(F.array(member(whole, F.size(longer), F.array_min(longer))), F.transform(longer, lambda r: member(r, F.lit(1), whole)))
    met = F.when(F.col("at") >= 0, wild).when((F.size(word) > 0) & (F.size(longer) > 0), indel)
    return groups.select(F.explode(met).alias("s")).groupBy("s.rank").agg(F.sum("s.n").alias("n_near"), F.min("s.best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(rank, root): the ends of chains (rank, form), by doubling. Chains are short: n grows along them by a factor."""
    now = written(links.select("rank", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("rank").alias("at"), F.col("root").alias("next"))
        far = written(now.join(ahead, F.col("root") == F.col("at"), "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if far.filter("moved").isEmpty():
            return far.select("rank", "root")
        now = far.select("rank", "root")


def variants(docs: DataFrame, least: int = 6, occurrences: int = 5, factor: int = 5, every: int | None = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``least`` code points that occurs ``occurrences`` times.

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the near word of the most occurrences
    (of equals the first in code-point order) if it has at least ``factor`` times the word's own; following forms leads
    to ``root``. Null and empty texts have no words; repeated rows count each; a null id counts as the empty string.
    Texts and words of any length are read whole. An empty table, or one without such words, gives an empty result.
    Other columns are not read, so their names can't clash.
    """
    with scratch(docs.sparkSession) as keep:
        words = ranked_words(word_counts(docs, least, every, id_col, text_col).filter(F.col("n") >= occurrences))
        near = near_words(words)
        best = words.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
        found = words.join(near, "rank", "left").join(best, "best", "left")
        far = F.col("best_n") >= factor * F.col("n")
        found = written(
            found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(far, F.col(c)).alias(to) for c, to in (("best", "form_rank"), ("best_word", "form"), ("best_n", "form_n"))]), "forms"
        )
        roots = _roots(found.filter("form_rank is not null").select("rank", F.col("form_rank").alias("form")))
        ends = roots.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select(F.col("rank").alias("at"), "root_word")
        out = found.join(ends, F.col("rank") == F.col("at"), "left")
        return keep(out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op11(spark, root):
    """Query op11_spelling_variants."""
    return variants(spark.read.parquet(f"{root}/documents.parquet"))
