"""How quality filters interact: what each of them removes, in every order of applying them.

Five filters judge whole texts: A few words, B few distinct words, C many capitals, D a symbol, E a copy of a document
with a smaller id. Copies are found by sorting: rows are dealt by ranges of (fingerprint, id), sorted by (fingerprint,
text, id) and compared with the row before. A group of copies may be cut by a range boundary, so each partition hands
on its first and last text, and the least id of a cut group is carried over the boundaries. The fingerprint is a SHA-256
digest, so that a boundary lies inside a group only where the texts are the same; texts are compared all the same.

What a document fails is a mask of five bits. Everything asked for is additive over documents, so (part, mask) counts
are all that is gathered, whatever the number of documents.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import bucket_count, row_chunks, scratch, text_bytes, utf8

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")


def failures(data: np.ndarray, offs: np.ndarray, least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 3, symbols: str = "#$%&*|") -> np.ndarray:
    """The bits of A to D for each text of packed UTF-8 bytes."""
    listed = np.zeros(256, bool)
    listed[list(symbols.encode("ascii"))] = True
    out = np.zeros(len(offs) - 1, np.int32)
    for a, b in row_chunks(offs):
        part, cuts = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        capitals, points, marks = (np.r_[0, np.cumsum(x)][cuts] for x in ((part >= 65) & (part <= 90), (part & 0xC0) != 0x80, listed[part]))
        raw, at = part.tobytes(), cuts.tolist()
        words = np.zeros((b - a, 2), np.int64)
        for i in range(b - a):
            found = raw[at[i] : at[i + 1]].split()  # cuts at 0x20 and 0x09-0x0D
            words[i] = len(found), len(set(found))
        out[a:b] = (words[:, 0] < least_words) | (100 * words[:, 1] < distinct_percent * words[:, 0]) << 1
        out[a:b] |= (100 * np.diff(capitals) > capitals_percent * np.diff(points)) << 2 | (np.diff(marks) > 0) << 3
    return out


def _larger(a, b) -> bool:
    """Whether id a is larger than b; a null is the least."""
    return a is not None and (b is None or a > b)


def _compare(kind: str, rules: dict):
    """Rows in order of (fingerprint, text, id) to their masks, and one edge row for each partition."""

    def run(batches):
        part, before, text, least, group, first = TaskContext.get().partitionId(), None, b"", None, -1, ""
        id_type = None
        for batch in batches:
            prints, ids, (data, offs) = batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))
            id_type, at = batch.column(1).type, offs.tolist()
            masks = failures(data, offs, **rules)
            head = np.zeros(len(ids), bool)
            for i, (p, ident) in enumerate(zip(prints, ids)):
                now = data[at[i] : at[i + 1]].tobytes()
                if p != before or now != text:
                    before, text, least, group = p, now, ident, group + 1
                    if not group:
                        first = now.decode()
                elif _larger(ident, least):
                    masks[i] |= COPY
                head[i] = not group
            n = len(ids)
            none = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), pa.array(head), pa.array(masks), batch.column(1), batch.column(3), none, none], NAMES)
        if group >= 0:
            row = [[part], [True], [group == 0], [0], [least], [None], [first], [text.decode()]]
            kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), id_type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], NAMES)

    return run, f"range int, edge boolean, head boolean, mask int, ident {kind}, part string, first string, last string"


NAMES = ["range", "edge", "head", "mask", "ident", "part", "first", "last"]


def _carried(rows: DataFrame) -> DataFrame:
    """(range, least): for each range whose first group began in an earlier one, the least id of that group.

    Texts are compared by a join of neighbouring ranges; the driver gets four small values of each range.
    """
    edges = rows.filter("edge").select("range", F.col("head").alias("alone"), "ident", "first", "last")
    order = sorted(r[0] for r in edges.select("range").collect())
    spark, kind = rows.sparkSession, rows.schema["ident"].dataType.simpleString()
    after = spark.createDataFrame(list(zip(order, order[1:])), "range int, next int")
    tails = edges.select("range", "last").join(F.broadcast(after), "range").select(F.col("next").alias("range"), F.col("last").alias("before"))
    same = edges.join(tails, "range", "left").select("range", "alone", "ident", F.coalesce(F.col("first") == F.col("before"), F.lit(False)).alias("same"))
    found, least = [], None
    for r in sorted(same.collect(), key=lambda r: r["range"]):
        if r["same"]:
            found.append((r["range"], least))
        if not (r["same"] and r["alone"]):
            least = r["ident"]
    return spark.createDataFrame(found, f"range int, least {kind}")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **rules) -> DataFrame:
    """(ident, part, mask) for every row: bit i is set if filter ``LETTERS[i]`` fails. ``rules``: those of ``failures``.

    A written table, which the caller's ``scratch`` deletes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("print"), F.col(id_col).alias("ident"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    dealt = rows.repartitionByRange(bucket_count(text_bytes(docs, text_col)), "print", F.asc_nulls_first("ident"))
    run, schema = _compare(kind, rules)
    with scratch(docs.sparkSession) as keep:
        seen = keep(dealt.sortWithinPartitions("print", "text", F.asc_nulls_first("ident")).mapInArrow(run, schema), "masks")
    ranges = F.broadcast(_carried(seen).withColumn("cut", F.lit(True)))  # a row for each range at most
    joined = seen.filter("not edge").join(ranges, "range", "left")
    copy = F.col("ident").isNotNull() & (F.col("least").isNull() | (F.col("ident") > F.col("least")))
    mask = F.when(F.col("head") & F.col("cut") & copy, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return joined.select("ident", "part", mask.alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **rules) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part,
    each of the 120 orders and each step.

    Parts are the values of ``part_col``; null and the empty string are one part. Null texts are empty, have no words and
    fail A; they are copies of each other and of empty texts. Of copies all but those with the least id fail E: a null id
    is the least, and rows that repeat an id do not fail for each other. Rows are documents each, also where ids repeat.
    A document is good or toxic if any row of ``labels`` (doc_id, quality, toxic) with its id says 1; null ids and values
    are no labels. A text of any length is judged whole in one task. An empty table gives an empty result. Other columns
    are not read, so their names can't clash.
    """
    with scratch(docs.sparkSession) as keep:
        rows = masks(docs, id_col, text_col, part_col, **rules)
        flags = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]).filter("good = 1 or toxic = 1")
        plain = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
        marked = rows.join(flags, F.col("ident") == F.col("_labelled")).groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
        counts = keep(plain.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "mask-counts")
        return keep(interactions(counts), "audit")


def interactions(counts: DataFrame) -> DataFrame:
    """The audit from (part, mask, n, good, toxic): at most 32 rows a part, so a part is one array."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = [("".join(o), k + 1, 1 << LETTERS.index(o[k]), sum(1 << LETTERS.index(x) for x in o[:k])) for o in itertools.permutations(LETTERS) for k in range(len(o))]
    # orders in which exactly this set comes before the filter
    orders = {(bit, before): sum(s[2:] == (bit, before) for s in steps) for _, _, bit, before in steps}
    listed = F.from_json(F.lit(str([{"filter_order": o, "step": k, "bit": b, "before": s} for o, k, b, s in steps]).replace("'", '"')), "array<struct<filter_order string, step int, bit int, before int>>")

    def total(value: str, met) -> F.Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(met(m["mask"]), m[value]).otherwise(F.lit(0)))

    def fails(m):
        return m.bitwiseAND(F.col("bit")) != 0

    def there(m):
        return m.bitwiseAND(F.col("before")) == 0

    shares = F.create_map(*[F.lit(v) for (bit, before), n in orders.items() for v in (bit * 32 + before, n)])
    gains = parts.select("part", "masks", F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in orders])).alias("s")).select("part", "masks", "s.*")
    gains = gains.select("part", "bit", (total("n", lambda m: fails(m) & there(m)) * shares[F.col("bit") * 32 + F.col("before")]).alias("gain")).groupBy("part", "bit").agg(F.sum("gain").alias("shapley"))
    rows = parts.select("part", "masks", F.explode(listed).alias("s")).select("part", "masks", "s.*").join(gains, ["part", "bit"])
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total("n", lambda m: fails(m) & there(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~there(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: fails(m) & there(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & there(m)).alias("toxic_lost"),
        "shapley",
    )


def op13(spark, root):
    """Query op13_filter_audit."""
    return audit(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))


SQL = r"""
WITH t AS (SELECT coalesce(doc_id, -9223372036854775808) AS id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
     flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
               FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
     m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
                  + 4 * CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS INT)
                  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                  + 16 * CAST(id > min(id) OVER (PARTITION BY text) AS INT) AS mask
           FROM w LEFT JOIN flags ON id = doc_id),
     c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
     l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
     o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
           WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
     s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
           FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
