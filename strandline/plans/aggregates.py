"""Aggregations: run summaries, distributions, mergeable and weighted statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import reports as R
from strandline.operators import sketches as K
from strandline.operators import stats as S
from strandline.operators.joins import offsets
from strandline.plans.common import FRAMES, frames, fresh_folder
from strandline.sources.tables import table

c = F.col
#: Rows of one digest of a catalog.
DIGEST_BLOCK = 4096


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def summary(spark, root):
    lengths = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("length"))
    orders = table(spark, root, "orders").join(lengths, c("o_orderkey") == c("l_orderkey"))
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("episodes"), F.sum("length").alias("frames"))


def run_summary(spark, root):
    """Sections of an event log: per-stage latency of completed and failed calls, usage of completed calls only, status
    of each user by the last event, counts by event."""
    log = table(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    counts = log.groupBy("event_type").agg(F.count("*").cast("double").alias("value")).select(F.lit("events").alias("section"), c("event_type").alias("name"), "value")
    calls = log.filter(c("event_type").isin("purchase", "error"))
    ends = S.exact_quantiles(calls, "value", [], {"p50": 0.5, "p95": 0.95}).select(F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))
    latency = ends.crossJoin(calls.agg(F.max("value").alias("max")))  # one row each
    latency = latency.select(F.lit("latency").alias("section"), F.explode(F.create_map(F.lit("p50"), "p50", F.lit("p95"), "p95", F.lit("max"), "max")).alias("name", "value"))
    usage = log.filter("event_type = 'purchase'").agg(F.sum("k").cast("double").alias("value")).select(F.lit("usage").alias("section"), F.lit("k").alias("name"), "value")
    status = log.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s")).groupBy("s").agg(F.count("*").cast("double").alias("value"))
    return counts.unionByName(latency).unionByName(usage).unionByName(status.select(F.lit("status").alias("section"), c("s").alias("name"), "value"))


def planned_totals(spark, root):
    """Per shard the last plan wins; then plans add up."""
    log = table(spark, root, "events").withColumn("shard", c("user_id") % 8)
    last = R.latest(log.filter("event_type = 'signup'"), ["shard"], c("event_id"))
    return last.agg(F.count("*").alias("shards"), F.round(F.sum("value"), 6).alias("planned"))


def scores(spark, root):
    runs = table(spark, root, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    kept = R.first_n_per_key(runs, ["l_suppkey"], [c("l_orderkey"), c("l_linenumber"), c("l_discount")], 50)
    return R.score_distribution(kept, ["l_suppkey"], "l_discount")


def by_status(spark, root):
    docs = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id", "left")
    status = F.when(c("quality").isNull(), "pending").when(c("quality") == 1, "accepted").otherwise("quarantined")
    return docs.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(c("toxic") == 1).alias("toxic"))


def adaptive(spark, root):
    """Running statistics of batches of 100 events: mean, deviation and left-edge quantiles of a histogram of 5,000 bins
    that is dealt anew whenever a batch widens its range."""
    e = table(spark, root, "events").select("event_type", F.floor(c("event_id") / 100).alias("batch"), "value")
    moments = S.finish_moments(S.moments(e, c("value"), "event_type"))
    q = S.left_edge_quantiles(S.adaptive_histogram(e, "event_type", "batch", "value"), "event_type", [0.01, 0.99])
    wide = q.groupBy("event_type").agg(*[F.max(F.when(c("q") == p, c("value"))).alias(n) for n, p in (("q01", 0.01), ("q99", 0.99))])
    return moments.join(wide, "event_type").select("event_type", "n", *r6("mean", "std", "q01", "q99"))


def sketched(spark, root):
    """Quantile state of each user's events, stored, and merged by event type: the answers' ranks are within the bound."""
    at, shares = fresh_folder(spark, "sketches"), [0.01, 0.1, 0.5, 0.9, 0.99]
    e = table(spark, root, "events")
    K.sketched(e, ["user_id", "event_type"], {"value": c("value")}).write.parquet(at)
    done = K.quantiles(K.merged(spark.read.parquet(at), ["event_type"], ["value"]), "value", shares)
    asked = done.select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("quantiles").alias("answer"))).alias("a")).select("event_type", "a.share", "a.answer")
    # one row for each type and share
    ranks = e.join(F.broadcast(asked), "event_type").groupBy("event_type", "share").agg(F.count("*").alias("n"), F.avg((c("value") <= c("answer")).cast("int")).alias("rank"))
    return ranks.select("event_type", "share", "n", (F.abs(c("rank") - c("share")) <= 3 * K.rank_error()).alias("within"))


def light_stats(spark, root):
    """Statistics without quantiles: only the columns asked for are read."""
    s = S.finish_moments(S.moments(table(spark, root, "lineitem"), c("l_quantity"), "l_returnflag"))
    return s.select("l_returnflag", "n", *r6("mean", "std", "lo", "hi"))


def histogram_quantiles(spark, root):
    e = table(spark, root, "events").select("event_type", "value")
    out = S.histogram_quantiles(S.histogram(e, "value", "event_type", 2048), "event_type", 2048, [0.01, 0.5, 0.99])
    return out.select("event_type", c("q").cast("double").alias("q"), F.round("value", 6).alias("value"))


def merged_moments(spark, root):
    parts = S.moments(table(spark, root, "events"), c("value"), "event_type", "user_id")
    done = S.finish_moments(S.merge_moments(parts, "event_type"))
    return done.select("event_type", "n", *r6("mean", "std", "lo", "hi"))


def grouped_merge(spark, root):
    per = table(spark, root, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min("value").alias("min"), F.max("value").alias("max"))
    return S.merge_grouped(per, "event_type").select("event_type", "n", *r6("mean", "var", "min", "max"))


def weighted(spark, root):
    e = table(spark, root, "events")
    per = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    per = per.join(S.exact_quantiles(e, "value", ["event_type"], {"q01": 0.01, "q99": 0.99}), "event_type")
    return S.weighted_merge(per, "n").select(*r6("mean", "std", "min", "max", "q01", "q99"))


def per_episode(spark, root):
    return frames(spark, root).groupBy("episode").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def without_near_zeros(spark, root):
    """Mean over all rows; deviation around it over rows that are not near zero."""
    far = F.abs("value") > 1.0
    n = F.greatest(F.count_if(far), F.lit(1))
    s1, s2 = F.sum(F.when(far, c("value")).otherwise(0.0)), F.sum(F.when(far, c("value") * c("value")).otherwise(0.0))
    return table(spark, root, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) ** 2, F.lit(0.0))), 6).alias("std"), F.count_if(far).alias("far"))


def window_deltas(spark, root):
    """Change over 5 frames; the sane bounds and those of accumulators that start at zero."""
    w = Window.partitionBy("episode").orderBy("frame")
    d = frames(spark, root).withColumn("d", F.lead("value", 5).over(w) - c("value")).filter("d is not null")
    return d.groupBy("episode").agg(*[F.round(x, 6).alias(n) for n, x in (("min", F.min("d")), ("max", F.max("d")), ("min0", F.least(F.min("d"), F.lit(0.0))), ("max0", F.greatest(F.max("d"), F.lit(0.0))), ("q99", F.percentile("d", 0.99)))])


def stepwise(spark, root):
    """Statistics of a[t+h] - a[t] for each step h of the horizon, edges clamped."""
    w = Window.partitionBy("episode").orderBy("frame").rowsBetween(0, 7)
    chunk = frames(spark, root).withColumn("a", F.collect_list("value").over(w))
    steps = chunk.select("value", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.get("a", F.least(h, F.size("a") - 1)))).alias("step", "v"))
    d = c("v") - c("value")
    return steps.groupBy(c("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d), 6).alias("std"), F.round(F.min(d), 6).alias("min"), F.round(F.max(d), 6).alias("max"))


def two_level_bounds(spark, root):
    per = table(spark, root, "events").groupBy("event_type", "user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.array_sort(F.collect_set(F.when(c("value") > 100, c("event_id")))).alias("out"))
    return per.groupBy("event_type").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.size("out") > 0).alias("users"), F.sum(F.size("out")).alias("outliers"))


def normaliser(spark, root):
    """Fit of both kinds: limits with constant dimensions at their midpoint, Gaussian with the sample deviation."""
    st = S.long_form(table(spark, root, "embeddings"), "embedding").groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    flat = c("hi") - c("lo") < 1e-4
    scale = F.when(flat, 1.0).otherwise(2 / (c("hi") - c("lo")))
    offset = F.when(flat, -(c("lo") + c("hi")) / 2).otherwise(-1 - scale * c("lo"))
    return st.select(c("dim").cast("long").alias("dim"), F.round(scale, 6).alias("scale"), F.round(offset, 6).alias("shift"), F.round(1 / c("std"), 6).alias("gauss_scale"), F.round(-c("mean") / c("std"), 6).alias("gauss_shift"))


def ranges(spark, root):
    """[from, to) of each order's lines in file order (order, line)."""
    per = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return offsets(per, "l_orderkey", "n").select("l_orderkey", c("start").alias("from_index"), c("stop").alias("to_index"))


def group_indices(spark, root):
    d = frames(spark, root).groupBy("episode", "event_type").agg(F.array_sort(F.collect_list("frame")).alias("i"))
    return d.select("episode", "event_type", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("indices"))


def success_rate(spark, root):
    o = table(spark, root, "orders").join(table(spark, root, "customer"), c("o_custkey") == c("c_custkey"))
    return o.groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus").agg(F.count_if(c("o_totalprice") > 200000).alias("success"), F.count("*").alias("total"), F.round(F.count_if(c("o_totalprice") > 200000) / F.count("*"), 6).alias("rate"))


def pivot(spark, root):
    e = table(spark, root, "events").withColumn("step", c("user_id") % 10)
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = e.groupBy("step").pivot("event_type", kinds).agg(F.avg("value"))
    row = sum((c(k) for k in kinds[1:]), c(kinds[0])) / len(kinds)
    return p.select("step", *r6(*kinds), F.round(row, 6).alias("average"))


def micro(spark, root):
    e = table(spark, root, "events").groupBy((c("user_id") % 7).alias("task")).agg(
        F.count_if((c("event_type") == "purchase") & (c("user_id") % 2 == 0)).alias("s0"), F.count_if(c("user_id") % 2 == 0).alias("n0"), F.count_if((c("event_type") == "purchase") & (c("user_id") % 2 == 1)).alias("s1"), F.count_if(c("user_id") % 2 == 1).alias("n1")
    )
    return e.agg(F.round(F.sum("s0") / F.sum("n0"), 6).alias("base"), F.round(F.sum("s1") / F.sum("n1"), 6).alias("random"))


def classifier(spark, root):
    pred, true = c("value") > 50, c("event_type") == "purchase"
    n = table(spark, root, "events").groupBy((c("user_id") % 5).alias("fold")).agg(F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"), F.count_if(~pred & true).alias("fn"), F.count_if(~pred & ~true).alias("tn"))
    m = n.select("*", *[v.alias(k) for k, v in R.classifier_metrics(c("tp"), c("fp"), c("fn"), c("tn")).items()])
    back = R.counts_from_rates(c("recall"), c("precision"), c("tp") + c("fn"))
    return m.select("fold", *r6("accuracy", "precision", "recall", "f1", "positive_rate"), *[F.round(v, 3).alias(f"{k}_back") for k, v in back.items()])


def inventory(spark, root):
    d = table(spark, root, "documents")
    return d.agg(F.countDistinct("source").alias("datasets"), F.count("*").alias("episodes"), F.sum("n_chars").alias("frames"), F.countDistinct("lang").alias("tasks"))


def digest(spark, root):
    """Digest of the catalog as canonical JSON (rows sorted, keys sorted, nulls kept) per language.

    Rows of ``DIGEST_BLOCK`` ids at a time are digested on their own, and the digest of a catalog is that of its blocks'
    digests in order, in two levels: no task holds more than a block of rows or of digests.
    """
    d = table(spark, root, "documents")
    line = F.concat(F.lit('{"doc_id":'), c("doc_id").cast("string"), F.lit(',"n_chars":'), F.coalesce(c("n_chars").cast("string"), F.lit("null")), F.lit(',"source":"'), c("source"), F.lit('"}'))
    rows = d.select("lang", c("doc_id").alias("at"), line.alias("j"), F.lit(1).alias("n"))
    for level in range(1, 4):
        block = F.floor(c("at") / DIGEST_BLOCK) if level < 3 else F.lit(0)
        parts = rows.groupBy("lang", block.alias("at")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "j"))).alias("r"))
        rows = parts.select("lang", "at", "n", F.sha2(F.concat(F.lit("["), F.array_join(c("r.j"), ","), F.lit("]")), 256).alias("j"))
    return rows.select("lang", "n", c("j").alias("digest"))


def balance(spark, root):
    per = table(spark, root, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return per.agg(F.count("*").alias("shards"), F.round(F.avg("n"), 6).alias("avg"), F.round(F.stddev_pop("n"), 6).alias("std"))


def advantage(spark, root):
    a = R.group_advantage(table(spark, root, "events"), "user_id", "value")
    return a.select("event_id", F.round("advantage", 5).alias("advantage"))


def first_reason(spark, root):
    """The first event of each (user, type) is its reason; later repeats don't count."""
    e = table(spark, root, "events")
    return e.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"), F.count("*").alias("repeats"))


def unique_in_order(spark, root):
    first = frames(spark, root).groupBy("episode", "event_type").agg(F.min("frame").alias("at"))
    ordered = first.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("s"))
    return ordered.select("episode", F.array_join(c("s.event_type"), ",").alias("kinds"))


def rollup(spark, root):
    o = table(spark, root, "orders")
    g = o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return g


QUERIES = [
    ("a10_v24_sketches", sketched, "SELECT event_type, share, count(*) AS n, true AS within FROM events, (SELECT unnest([0.01, 0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS share) GROUP BY 1, 2"),
    ("v16_light_stats", light_stats, "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(min(l_quantity), 6) AS lo, round(max(l_quantity), 6) AS hi FROM lineitem GROUP BY 1"),
    ("a01_summary", summary, "SELECT o_orderpriority, count(*) AS episodes, CAST(sum(length) AS BIGINT) AS frames FROM orders JOIN (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"),
    ("a02_run_summary", run_summary, """
        WITH log AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
        SELECT 'events' AS section, event_type AS name, count(*)::DOUBLE AS value FROM log GROUP BY 2
        UNION ALL SELECT 'latency', 'p50', round(quantile_cont(value, 0.5), 3) FROM log WHERE event_type IN ('purchase', 'error')
        UNION ALL SELECT 'latency', 'p95', round(quantile_cont(value, 0.95), 3) FROM log WHERE event_type IN ('purchase', 'error')
        UNION ALL SELECT 'latency', 'max', max(value) FROM log WHERE event_type IN ('purchase', 'error')
        UNION ALL SELECT 'usage', 'k', sum(k)::DOUBLE FROM log WHERE event_type = 'purchase'
        UNION ALL SELECT 'status', s, count(*)::DOUBLE FROM (SELECT user_id, arg_max(event_type, event_id) AS s FROM log GROUP BY 1) GROUP BY 2"""),
    ("a02_planned_totals", planned_totals, "SELECT count(*) AS shards, round(sum(v), 6) AS planned FROM (SELECT user_id % 8 AS shard, arg_max(value, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1)"),
    ("a04_o04_t11_score_distribution", scores, """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_discount) AS rank, count(*) OVER (PARTITION BY l_suppkey) AS size FROM lineitem),
        k AS (SELECT l_suppkey, round(l_discount, 4) AS score, count(*) AS n FROM r WHERE size >= 50 AND rank <= 50 GROUP BY ALL)
        SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_scores,
               string_agg(n || ' x ' || regexp_replace(regexp_replace(printf('%.4f', score), '0+$', ''), '\\.$', ''), ', ' ORDER BY score DESC) AS distribution FROM k GROUP BY 1"""),
    ("a05_documents_by_status", by_status, "SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'accepted' ELSE 'quarantined' END AS status, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    ("a07_adaptive_histogram", adaptive, """
        WITH RECURSIVE e AS (SELECT event_type AS t, event_id // 100 AS b, value AS v FROM events),
        p AS (SELECT t, b, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1, 2),
        r AS (SELECT t, b, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM p WINDOW w AS (PARTITION BY t ORDER BY b)),
        g AS (SELECT *, lag(lo) OVER w AS l, lag(hi) OVER w AS h FROM r WINDOW w AS (PARTITION BY t ORDER BY b)),
        c AS (SELECT t, b, lo, hi, row_number() OVER (PARTITION BY t ORDER BY b) AS k FROM g WHERE l IS NULL OR l <> lo OR h <> hi),
        f AS (SELECT e.t, c.k, e.v AS edge, 1 AS fresh FROM e ASOF JOIN c ON e.t = c.t AND e.b >= c.b),
        m AS (SELECT f.t, f.k, CASE WHEN hi > lo THEN lo + greatest(least(floor((edge - lo) / (hi - lo) * 5000), 4999), 0) * (hi - lo) / 5000 ELSE lo END AS edge FROM f JOIN c USING (t, k)
              UNION ALL SELECT m.t, c.k, CASE WHEN hi > lo THEN lo + greatest(least(floor((edge - lo) / (hi - lo) * 5000), 4999), 0) * (hi - lo) / 5000 ELSE lo END FROM m JOIN c ON c.t = m.t AND c.k = m.k + 1),
        z AS (SELECT m.t, edge, count(*) AS n FROM m JOIN (SELECT t, max(k) AS k FROM c GROUP BY 1) USING (t, k) GROUP BY 1, 2),
        s AS (SELECT t, edge, sum(n) OVER (PARTITION BY t ORDER BY edge) AS seen, sum(n) OVER (PARTITION BY t) AS total FROM z),
        q AS (SELECT t, min(edge) FILTER (seen >= 0.01::DOUBLE * total) AS q01, min(edge) FILTER (seen >= 0.99::DOUBLE * total) AS q99 FROM s GROUP BY 1)
        SELECT t AS event_type, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(any_value(q01), 6) AS q01, round(any_value(q99), 6) AS q99 FROM e JOIN q USING (t) GROUP BY 1"""),
    ("a08_histogram_quantiles", histogram_quantiles, """
        WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
        h AS (SELECT event_type, greatest(least(CAST(floor((value - lo) / (hi - lo) * 2048) AS BIGINT), 2047), 0) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM events JOIN b USING (event_type) GROUP BY 1, 2),
        r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY event_type) AS total FROM h),
        q AS (SELECT unnest([0.01, 0.5, 0.99])::DOUBLE AS q)
        SELECT event_type, q, round(arg_min(lo + bin * (hi - lo) / 2048, bin), 6) AS value FROM r, q WHERE seen >= greatest(ceil(q * total), 1) GROUP BY 1, 2"""),
    ("a09_a10_merged_moments", merged_moments, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1"),
    ("a11_v24_grouped_merge", grouped_merge, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1"),
    ("a12_weighted_merge", weighted, """
        WITH p AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1)
        SELECT round(sum(n * mean) / sum(n), 6) AS mean, round(sqrt(sum(n * (std * std + mean * mean)) / sum(n) - (sum(n * mean) / sum(n)) ** 2), 6) AS std, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(sum(n * a) / sum(n), 6) AS q01, round(sum(n * b) / sum(n), 6) AS q99 FROM p"""),
    ("a13_per_episode", per_episode, f"WITH {FRAMES} SELECT episode, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM f GROUP BY 1"),
    ("a14_without_near_zeros", without_near_zeros, "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value) FILTER (abs(value) > 1), 6) AS std, count(*) FILTER (abs(value) > 1) AS far FROM events GROUP BY 1"),
    ("a15_window_deltas", window_deltas, f"WITH {FRAMES}, d AS (SELECT episode, lead(value, 5) OVER (PARTITION BY episode ORDER BY frame) - value AS d FROM f) SELECT episode, round(min(d), 6) AS min, round(max(d), 6) AS max, round(least(min(d), 0.0), 6) AS min0, round(greatest(max(d), 0.0), 6) AS max0, round(quantile_cont(d, 0.99), 6) AS q99 FROM d WHERE d IS NOT NULL GROUP BY 1"),
    ("a16_stepwise", stepwise, f"WITH {FRAMES}, n AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last FROM f), h AS (SELECT unnest(range(8)) AS step), d AS (SELECT step, b.value - a.value AS d FROM n a, h JOIN f b ON true WHERE b.episode = a.episode AND b.frame = least(a.frame + step, a.last)) SELECT step, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max FROM d GROUP BY 1"),
    ("a17_two_level_bounds", two_level_bounds, "SELECT event_type, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) FILTER (value > 100) AS users, count(*) FILTER (value > 100) AS outliers FROM events GROUP BY 1"),
    ("a18_normaliser_fit", normaliser, "WITH e AS (SELECT unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT dim, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS std FROM e GROUP BY 1) SELECT dim, round(2 / (hi - lo), 6) AS scale, round(-1 - 2 / (hi - lo) * lo, 6) AS shift, round(1 / std, 6) AS gauss_scale, round(-mean / std, 6) AS gauss_shift FROM s"),
    ("a19_w07_ranges", ranges, "WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(sum(n) OVER (ORDER BY l_orderkey) AS BIGINT) - n AS from_index, CAST(sum(n) OVER (ORDER BY l_orderkey) AS BIGINT) AS to_index FROM p"),
    ("a20_group_indices", group_indices, f"WITH {FRAMES} SELECT episode, event_type, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS indices FROM f GROUP BY 1, 2"),
    ("a21_success_rate", success_rate, "SELECT c_mktsegment, o_orderpriority, o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS success, count(*) AS total, round(count(*) FILTER (o_totalprice > 200000) / count(*), 6) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"),
    ("a22_pivot", pivot, "WITH p AS (SELECT user_id % 10 AS step, " + ", ".join(f"avg(value) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1) SELECT step, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + ", round((click + error + purchase + signup + view) / 5, 6) AS average FROM p"),
    ("a23_micro_average", micro, "SELECT round(count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 0) / count(*) FILTER (user_id % 2 = 0), 6) AS base, round(count(*) FILTER (event_type = 'purchase' AND user_id % 2 = 1) / count(*) FILTER (user_id % 2 = 1), 6) AS random FROM events"),
    ("a24_a25_classifier", classifier, """
        WITH n AS (SELECT user_id % 5 AS fold, count(*) FILTER (value > 50 AND event_type = 'purchase')::DOUBLE AS tp, count(*) FILTER (value > 50 AND event_type <> 'purchase')::DOUBLE AS fp,
                          count(*) FILTER (value <= 50 AND event_type = 'purchase')::DOUBLE AS fn, count(*) FILTER (value <= 50 AND event_type <> 'purchase')::DOUBLE AS tn FROM events GROUP BY 1),
        m AS (SELECT *, tp / greatest(tp + fp, 1e-6) AS p, tp / greatest(tp + fn, 1e-6) AS r FROM n)
        SELECT fold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-6), 6) AS f1,
               round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_rate, round(tp, 3) AS tp_back, round(fp, 3) AS fp_back, round(fn, 3) AS fn_back FROM m"""),
    ("a26_inventory", inventory, "SELECT count(DISTINCT source) AS datasets, count(*) AS episodes, CAST(sum(n_chars) AS BIGINT) AS frames, count(DISTINCT lang) AS tasks FROM documents"),
    ("a27_t05_digest", digest, """
        WITH a AS (SELECT lang, doc_id // 4096 AS bk, count(*) AS n, sha256('[' || string_agg('{"doc_id":' || doc_id || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":"' || source || '"}', ',' ORDER BY doc_id) || ']') AS j FROM documents GROUP BY 1, 2),
        b AS (SELECT lang, bk // 4096 AS bk, sum(n) AS n, sha256('[' || string_agg(j, ',' ORDER BY a.bk) || ']') AS j FROM a GROUP BY 1, 2)
        SELECT lang, CAST(sum(n) AS BIGINT) AS n, sha256('[' || string_agg(j, ',' ORDER BY bk) || ']') AS digest FROM b GROUP BY 1"""),
    ("a28_balance", balance, "WITH p AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1) SELECT count(*) AS shards, round(avg(n), 6) AS avg, round(stddev_pop(n), 6) AS std FROM p"),
    ("a30_advantage", advantage, "SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-6), 5) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)"),
    ("a31_first_reason", first_reason, "SELECT user_id, event_type, arg_min(value, event_id) AS value, count(*) AS repeats FROM events GROUP BY 1, 2"),
    ("a32_unique_in_order", unique_in_order, f"WITH {FRAMES}, u AS (SELECT episode, event_type, min(frame) AS seen FROM f GROUP BY 1, 2) SELECT episode, string_agg(event_type, ',' ORDER BY seen) AS kinds FROM u GROUP BY 1"),
    ("x_rollup", rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
]
