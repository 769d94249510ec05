"""Sampling, sharding, batching, set operations and dataset edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import edits as E
from strandline.operators import ranks
from strandline.operators import sampling as S
from strandline.plans.common import FRAMES, frames
from strandline.sources.tables import table

c = F.col
#: SQL of ``hash_unit``: fill in the joined parts.
UNIT = "(CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def u(parts):
    return UNIT.format(parts)


def docs(spark, root):
    return table(spark, root, "documents").select("doc_id", "source", "lang", "n_chars")


def group_batches(spark, root):
    return S.group_batches(docs(spark, root), "doc_id", "source", "doc_id", 8, 4, 1, 0)


def batch_stats(spark, root):
    b = group_batches(spark, root)
    per = b.groupBy("batch").agg(F.countDistinct("source").alias("tasks"), F.count_if(~c("valid")).alias("padded"), F.count("sample").alias("draws"))
    return per.agg(F.count("*").alias("batches"), F.sum("draws").alias("draws"), F.sum("padded").alias("padded"), F.count_if(c("tasks") > 1).alias("mixed"))


def collated(spark, root):
    b = S.fixed_batches(docs(spark, root), ["lang"], "doc_id", 16, 5)
    g = b.groupBy("lang", "batch").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id"))).alias("s"))
    return g.select("lang", "batch", F.size("s").cast("long").alias("n"), F.array_join(c("s.doc_id").cast("array<string>"), ",").alias("ids"))


def mixture(spark, root):
    w = docs(spark, root).groupBy("lang").agg(F.sum("n_chars").cast("double").alias("w"))
    return S.mixture_draws(w, "lang", "w", 5000, 3).groupBy("lang").agg(F.count("*").alias("draws"))


def two_level(spark, root):
    """Draw a language by weight, then a document of it uniformly by hash."""
    d = docs(spark, root)
    w = d.groupBy("lang").agg(F.count("*").cast("double").alias("w"))
    draws = S.mixture_draws(w, "lang", "w", 3000, 9)
    r = ranks.position(d, "doc_id", ["lang"], name="k").select("lang", "doc_id", "k")
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    picked = draws.join(n, "lang").withColumn("k", F.floor(S.hash_unit(10, c("draw")) * c("n")))
    return picked.join(r, ["lang", "k"]).select("draw", "doc_id")


def weights(spark, root):
    """Uniform, episode and frame mixture weights, normalised and rounded to 8 places; the frame scale of effective sizes."""
    d = docs(spark, root).groupBy("source").agg(F.count("*").alias("episodes"), F.sum("n_chars").alias("frames"))
    a = Window.partitionBy(F.lit(0))
    w = (c("source") == "src0").cast("int") + 1
    k = F.sum("frames").over(a) / F.sum(w * c("frames")).over(a)
    return d.select("source", F.round(1 / F.count("*").over(a), 8).alias("uniform"), F.round(c("episodes") / F.sum("episodes").over(a), 8).alias("by_episode"), F.round(c("frames") / F.sum("frames").over(a), 8).alias("by_frame"), F.floor(c("frames") * w * k).alias("effective"))


def rank_split(spark, root):
    return S.rank_split(docs(spark, root).select("doc_id"), "doc_id", 7, True).select("doc_id", "rank", "place")


def rank_drop(spark, root):
    return S.rank_split(docs(spark, root).select("doc_id"), "doc_id", 7, False).select("doc_id", "rank", "place")


def workers(spark, root):
    """Rank by id modulo 4, then contiguous parts of 3 workers."""
    d = docs(spark, root).select("doc_id", (c("doc_id") % 4).alias("rank"))
    r = ranks.position(d, "doc_id", ["rank"], name="place")
    return r.select("doc_id", "rank", F.floor(c("place") * 3 / c("total")).alias("worker"))


def repeats(spark, root):
    return S.fractional_repeat(docs(spark, root).select("doc_id"), "doc_id", 2.3, 4).select("doc_id", c("copy").cast("long").alias("copy"))


def shard(spark, root):
    """Disjoint, complete shards by hash."""
    return docs(spark, root).select("doc_id", F.floor(S.hash_unit("shard", c("doc_id")) * 16).alias("shard"))


def sub(spark, root):
    return S.at_most(docs(spark, root), ["source"], "doc_id", 5, 11).select("source", "doc_id")


def dropout(spark, root):
    keep = S.hash_unit("drop", c("doc_id")) >= 0.3
    return docs(spark, root).select("doc_id", F.when(keep, c("lang")).alias("goal"))


def budget(spark, root):
    """First fit of documents into batches of 20,000 characters, for two workers of each source with ten waiting items."""
    d = docs(spark, root).withColumn("worker", c("doc_id") % 2)
    return S.budget_batches(d, ["source", "worker"], "doc_id", "n_chars", 20000, 10)


def positions(spark, root):
    """Packed position ids: running lengths inside each batch of the budget rule."""
    b = budget(spark, root).join(docs(spark, root).select("doc_id", "n_chars"), "doc_id")
    end = F.sum("n_chars").over(Window.partitionBy("source", "worker", "batch").orderBy("doc_id"))
    return b.select("doc_id", "batch", (end - c("n_chars")).alias("start"), end.alias("stop"))


#: One step of the recursion takes a batch from what waits, or lets the next item in, or both.
BUDGET_SQL = """WITH RECURSIVE d AS (SELECT source, doc_id % 2 AS worker, {'i': doc_id, 's': n_chars} AS item, row_number() OVER w AS k, count(*) OVER (PARTITION BY source, doc_id % 2) AS n
                                    FROM documents WINDOW w AS (PARTITION BY source, doc_id % 2 ORDER BY doc_id)),
  r AS (SELECT source, worker, n, k, [item] AS waiting, -1::BIGINT AS batch, []::BIGINT[] AS taken FROM d WHERE k = 1
        UNION ALL
        SELECT source, worker, n, k + (next IS NOT NULL)::INT, list_filter(waiting, lambda x: NOT list_contains(now, x.i)) || CASE WHEN next IS NULL THEN [] ELSE [next] END, batch + (len(now) > 0)::INT, now
        FROM (SELECT r.source, r.worker, r.n, r.k, waiting, batch, d.item AS next,
                     CASE WHEN r.k = r.n OR (len(waiting) >= 10 AND list_sum(list_transform(waiting, lambda x: x.s)) >= 20000)
                          THEN list_reduce(waiting, lambda a, x: CASE WHEN a.used < 20000 AND (a.used = 0 OR x.s <= 20000 - a.used) THEN {'used': a.used + x.s, 'ids': list_append(a.ids, x.i)} ELSE a END, {'used': 0::BIGINT, 'ids': []::BIGINT[]}).ids
                          ELSE [] END AS now
              FROM r LEFT JOIN d ON d.source = r.source AND d.worker = r.worker AND d.k = r.k + 1 WHERE len(waiting) > 0)),
  b AS (SELECT source, worker, unnest(taken) AS doc_id, batch FROM r)"""


def allocated(spark, root):
    w = docs(spark, root).groupBy("source").agg(F.count("*").cast("double").alias("w"))
    return S.allocate(w, "source", "w", 64)


def same_length(spark, root):
    """Batches of equal history length: buckets by turns, chunks of 8, seeded chunk order."""
    t = table(spark, root, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    b = S.fixed_batches(t, ["turns"], "conv_id", 8, 2)
    return b.select("conv_id", "turns", "batch", "slot", F.round(S.hash_unit(6, c("turns"), c("batch")), 9).alias("place"))


def skipped(spark, root):
    """Resume: the same permutation without its first 300 ids."""
    return S.ranked(docs(spark, root).select("doc_id"), [], "doc_id", 8, 0).filter("rank >= 300").drop("total")


def length_filter(spark, root):
    """Episodes of 60 frames or more, cut to 50 by hash, order kept."""
    f = frames(spark, root).withColumn("n", F.count("*").over(Window.partitionBy("episode"))).filter("n >= 60")
    return S.at_most(f, ["episode"], "event_id", 50, 12).select("episode", "event_id")


def merged(spark, root):
    a, b = docs(spark, root).filter("lang = 'en'").drop("source"), docs(spark, root).filter("lang <> 'en'").drop("n_chars")
    return E.reindex(E.merge([a, b]), "doc_id", "new_id", ["dataset_index"]).select("doc_id", c("dataset_index").cast("long").alias("dataset_index"), "new_id", "lang")


def deleted(spark, root):
    gone = table(spark, root, "labels").filter("quality = 0").select("doc_id")
    return E.delete(docs(spark, root), "doc_id", gone).select("doc_id", "new_doc_id")


def splits(spark, root):
    return E.split(docs(spark, root), "doc_id", {"train": 0.8, "val": 0.1}, 21).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def last_as_validation(spark, root):
    """The mask that always takes the last episode; ``split`` is the sane default."""
    last = docs(spark, root).groupBy("source").agg(F.max("doc_id").alias("last"))
    return docs(spark, root).join(last, "source").select("doc_id", (c("doc_id") == c("last")).alias("val"))


def balanced(spark, root):
    """Suppliers in order, each with its lines to the shard of the fewest lines so far."""
    items = table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return S.greedy_balance(items, "l_suppkey", "l_suppkey", "n", 4)


def catalog_order(spark, root):
    """Place of each customer in the order of (nation, segment, key)."""
    return E.reindex(table(spark, root, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_custkey", "place", ["c_nationkey", "c_mktsegment"])


def limited(spark, root):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return docs(spark, root).withColumn("r", F.row_number().over(w)).filter("r <= 3").orderBy("lang", "doc_id").limit(10).select("lang", "doc_id")


RANKED = "row_number() OVER ({0} ORDER BY {1}, doc_id) - 1"
QUERIES = [
    ("b01_b02_group_batches", group_batches, f"""
        WITH r AS (SELECT doc_id, source, {RANKED.format('', u("'1|0|' || doc_id"))} AS rank, count(*) OVER () AS n FROM documents),
        d AS (SELECT doc_id, source, rank // 8 AS batch FROM r WHERE rank // 8 < n // 8),
        t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch, doc_id) - 1 AS turn FROM d),
        s AS (SELECT source, doc_id AS sample, {RANKED.format('PARTITION BY source', u("'1|0|cycle|' || doc_id"))} AS at, count(*) OVER (PARTITION BY source) AS size FROM documents),
        z AS (SELECT DISTINCT source, size FROM s), k AS (SELECT unnest(range(4)) AS slot)
        SELECT t.batch, t.doc_id, t.source, k.slot, s.sample, k.slot < z.size AS valid FROM t JOIN z USING (source) CROSS JOIN k LEFT JOIN s ON s.source = t.source AND k.slot < z.size AND s.at = (t.turn * 4 + k.slot) % z.size"""),
    ("a29_batch_stats", batch_stats, f"""
        WITH r AS (SELECT doc_id, source, {RANKED.format('', u("'1|0|' || doc_id"))} AS rank, count(*) OVER () AS n, count(*) OVER (PARTITION BY source) AS size FROM documents),
        d AS (SELECT rank // 8 AS batch, source, least(size, 4) AS k FROM r WHERE rank // 8 < n // 8),
        p AS (SELECT batch, count(DISTINCT source) AS tasks, sum(k) AS draws, sum(4 - k) AS padded FROM d GROUP BY 1)
        SELECT count(*) AS batches, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(padded) AS BIGINT) AS padded, count(*) FILTER (tasks > 1) AS mixed FROM p"""),
    ("b02_collated", collated, f"WITH r AS (SELECT lang, doc_id, {RANKED.format('PARTITION BY lang', u("'5|' || doc_id"))} AS rank FROM documents) SELECT lang, rank // 16 AS batch, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids FROM r GROUP BY 1, 2"),
    ("b03_v11_mixture", mixture, f"WITH w AS (SELECT lang, sum(n_chars)::DOUBLE AS w FROM documents GROUP BY 1), s AS (SELECT lang, sum(w) OVER (ORDER BY lang) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY lang) - w) / sum(w) OVER () AS lo FROM w), d AS (SELECT {u("'3|' || i")} AS u FROM range(5000) t(i)) SELECT lang, count(*) AS draws FROM d JOIN s ON u >= lo AND u < hi GROUP BY 1"),
    ("b04_two_level", two_level, f"WITH w AS (SELECT lang, count(*)::DOUBLE AS w FROM documents GROUP BY 1), s AS (SELECT lang, w AS n, sum(w) OVER (ORDER BY lang) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY lang) - w) / sum(w) OVER () AS lo FROM w), d AS (SELECT i AS draw, {u("'9|' || i")} AS u, {u("'10|' || i")} AS v FROM range(3000) t(i)), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) SELECT draw, doc_id FROM d JOIN s ON u >= lo AND u < hi JOIN r ON r.lang = s.lang AND r.k = floor(v * n)"),
    ("m21_m22_weights", weights, "WITH d AS (SELECT source, count(*) AS e, sum(n_chars)::DOUBLE AS f, CASE WHEN source = 'src0' THEN 2 ELSE 1 END AS w FROM documents GROUP BY 1) SELECT source, round(1 / count(*) OVER (), 8) AS uniform, round(e / sum(e) OVER (), 8) AS by_episode, round(f / sum(f) OVER (), 8) AS by_frame, CAST(floor(f * w * (sum(f) OVER () / sum(w * f) OVER ())) AS BIGINT) AS effective FROM d"),
    ("b05_rank_split", rank_split, "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents), q AS (SELECT doc_id, p FROM p UNION ALL SELECT doc_id, n + p FROM p WHERE p < (7 - n % 7) % 7) SELECT doc_id, p % 7 AS rank, p // 7 AS place FROM q"),
    ("b05_rank_drop", rank_drop, "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, p % 7 AS rank, p // 7 AS place FROM p WHERE p < n - n % 7"),
    ("b06_workers", workers, "SELECT doc_id, doc_id % 4 AS rank, (row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1) * 3 // count(*) OVER (PARTITION BY doc_id % 4) AS worker FROM documents"),
    ("b07_s18_repeats", repeats, f"WITH r AS (SELECT doc_id, {RANKED.format('', u("'4|' || doc_id"))} AS rank, count(*) OVER () AS n FROM documents) SELECT doc_id, unnest(range(2 + CASE WHEN rank < ceil(n * (2.3::DOUBLE - 2)) THEN 1 ELSE 0 END)) AS copy FROM r"),
    ("b15_shard", shard, f"SELECT doc_id, CAST(floor({u("'shard|' || doc_id")} * 16) AS BIGINT) AS shard FROM documents"),
    ("b12_b14_u10_subsample", sub, f"SELECT source, doc_id FROM (SELECT source, doc_id, {RANKED.format('PARTITION BY source', u("'11|' || doc_id"))} AS rank FROM documents) WHERE rank < 5"),
    ("b13_dropout", dropout, f"SELECT doc_id, CASE WHEN {u("'drop|' || doc_id")} >= 0.3 THEN lang END AS goal FROM documents"),
    ("b10_budget_batches", budget, BUDGET_SQL + " SELECT source, worker, doc_id, batch FROM b"),
    ("b11_positions", positions, BUDGET_SQL + ", q AS (SELECT b.source AS src, worker, batch, doc_id, n_chars AS s FROM b JOIN documents USING (doc_id)) SELECT doc_id, batch, CAST(sum(s) OVER w AS BIGINT) - s AS start, CAST(sum(s) OVER w AS BIGINT) AS stop FROM q WINDOW w AS (PARTITION BY src, worker, batch ORDER BY doc_id)"),
    ("o08_b16_allocate", allocated, "WITH w AS (SELECT source, count(*)::DOUBLE AS w FROM documents GROUP BY 1), x AS (SELECT source, w / sum(w) OVER () * (64 - count(*) OVER ()) AS x, count(*) OVER () AS n FROM w), f AS (SELECT *, floor(x) AS f FROM x), r AS (SELECT *, 64 - n - sum(f) OVER () AS rest, row_number() OVER (ORDER BY x - f DESC, source) AS r FROM f) SELECT source, CAST(f + 1 + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS part FROM r"),
    ("v12_same_length", same_length, f"WITH t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), r AS (SELECT conv_id, turns, row_number() OVER (PARTITION BY turns ORDER BY {u("'2|' || conv_id")}, conv_id) - 1 AS rank FROM t) SELECT conv_id, turns, rank // 8 AS batch, rank % 8 AS slot, round({u("'6|' || turns || '|' || (rank // 8)")}, 9) AS place FROM r"),
    ("v13_o09_resume", skipped, f"SELECT * FROM (SELECT doc_id, {RANKED.format('', u("'8|0|' || doc_id"))} AS rank FROM documents) WHERE rank >= 300"),
    ("v10_length_filter", length_filter, f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM f), r AS (SELECT episode, event_id, row_number() OVER (PARTITION BY episode ORDER BY {u("'12|' || event_id")}, event_id) AS r FROM n WHERE n >= 60) SELECT episode, event_id FROM r WHERE r <= 50"),
    ("u01_u02_merge", merged, "WITH m AS (SELECT doc_id, lang, 0::BIGINT AS dataset_index FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE lang <> 'en') SELECT *, row_number() OVER (ORDER BY dataset_index, doc_id) - 1 AS new_id FROM m"),
    ("f19_delete", deleted, "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    ("u08_split", splits, f"WITH r AS (SELECT doc_id, {RANKED.format('', u("'21|' || doc_id"))} AS rank, count(*) OVER () AS n FROM documents) SELECT CASE WHEN rank < floor(n * 0.8 + 1e-9) THEN 'train' WHEN rank < floor(n * 0.9::DOUBLE + 1e-9) THEN 'val' END AS split, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1"),
    ("u09_last_as_validation", last_as_validation, "SELECT doc_id, doc_id = max(doc_id) OVER (PARTITION BY source) AS val FROM documents"),
    ("o07_b08_greedy_balance", balanced, """
        WITH RECURSIVE i AS (SELECT l_suppkey, n, row_number() OVER (ORDER BY l_suppkey) AS k FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)),
        g AS (SELECT 0::BIGINT AS k, 0::BIGINT AS l_suppkey, [0, 0, 0, 0]::BIGINT[] AS used, -1::BIGINT AS shard, 0::BIGINT AS before
              UNION ALL SELECT i.k, i.l_suppkey, list_transform(used, lambda x, j: CASE WHEN j = list_position(used, list_min(used)) THEN x + i.n ELSE x END), list_position(used, list_min(used)) - 1, list_min(used)
              FROM g JOIN i ON i.k = g.k + 1)
        SELECT l_suppkey, shard, before FROM g WHERE k > 0"""),
    ("o02_catalog_order", catalog_order, "SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) - 1 AS place FROM customer"),
    ("o05_limits", limited, "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3 ORDER BY 1, 2 LIMIT 10"),
]
