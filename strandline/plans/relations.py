"""Joins, contracts, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import contracts as C
from strandline.operators import joins as J
from strandline.operators import windows as W
from strandline.plans.common import FRAMES, frames
from strandline.sources.tables import table

c = F.col


def order_ranges(spark, root):
    """[start, stop) of each order's lines laid end to end by order key."""
    per = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("length"))
    return J.offsets(per, "l_orderkey", "length")


def interval(spark, root):
    """Order whose line range holds five times the event number."""
    points = table(spark, root, "events").select("event_id", (c("event_id") * 5).alias("p"))
    return J.range_join(points, "p", order_ranges(spark, root), "start", "stop", 64).select("event_id", "l_orderkey", (c("p") - c("start")).alias("local"))


def interval_semi(spark, root):
    """Frames allowed by ranges [5, 20) of even and [30, 33) of odd episodes."""
    f = frames(spark, root).withColumn("g", c("episode") * 1000 + c("frame"))
    allow = f.groupBy("episode").agg(F.count("*").alias("n")).select(F.when(c("episode") % 2 == 0, c("episode") * 1000 + 5).otherwise(c("episode") * 1000 + 30).alias("lo"), F.when(c("episode") % 2 == 0, c("episode") * 1000 + 20).otherwise(c("episode") * 1000 + 33).alias("hi"))
    return J.range_join(f, "g", allow, "lo", "hi", 1000, "left_semi").select("event_id")


def _micros(df, name="t"):
    return df.withColumn(name, F.unix_micros(c("ts").cast("timestamp")))


def asof_signup(spark, root):
    e = _micros(table(spark, root, "events"))
    right = e.filter("event_type = 'signup'").select("user_id", c("t").alias("rt"), c("event_id").alias("signup_id"), c("value").alias("signup_value"))
    return J.asof(e.filter("event_type = 'purchase'").select("user_id", "event_id", "t"), right, ["user_id"], "t", "rt", "signup_id", ["signup_id", "signup_value"]).select("event_id", "signup_id", "signup_value")


def nearest_view(spark, root):
    e = _micros(table(spark, root, "events"))
    right = e.filter("event_type = 'view'").select("user_id", c("t").alias("rt"), c("event_id").alias("view_id"))
    return J.nearest(e.filter("event_type = 'purchase'").select("user_id", "event_id", "t"), right, ["user_id"], "t", "rt", "view_id", "view_id").select("event_id", "view_id")


def interpolated(spark, root):
    e = table(spark, root, "events").withColumn("t", F.unix_micros(c("ts").cast("timestamp")) / 1e6)
    right = e.filter("event_type = 'view'").select("user_id", c("t").alias("rt"), c("value").alias("v"))
    return J.interpolated(e.filter("event_type = 'purchase'").select("user_id", "event_id", "t"), right, ["user_id"], "t", "rt", "v").select("event_id", F.round("v", 5).alias("v"))


def unit_boundaries(spark, root):
    """Each turn pair with its roles on both sides."""
    t = table(spark, root, "conversations")
    units = W.chain(t, "conv_id", "turn", "turn")
    b = t.select("conv_id", c("turn").alias("before"), c("role").alias("role_before"))
    a = t.select("conv_id", c("turn").alias("after"), c("role").alias("role_after"))
    return units.join(b, ["conv_id", "before"]).join(a, ["conv_id", "after"])


def lookup(spark, root):
    """Names by key; a customer without a nation would be a violation."""
    cu, n = table(spark, root, "customer"), table(spark, root, "nation")
    return J.checked_lookup(cu, n, c("c_nationkey") == c("n_nationkey"), "n_name", "no nation").groupBy("n_name").agg(F.count("*").alias("n"))


def run_keys(spark, root):
    e = table(spark, root, "events").select("user_id", "event_type").distinct()
    a, b = e.filter("event_type = 'signup'").select("user_id"), e.filter("event_type = 'error'").select("user_id")
    return a.join(b, "user_id")


def partners(spark, root):
    p = table(spark, root, "part").select("p_brand", "p_type").distinct()
    left = p.filter("p_type like 'ECONOMY%'").select("p_brand", c("p_type").alias("base"))
    right = p.select(c("p_brand").alias("b"), c("p_type").alias("partner"))
    return left.join(right, (c("p_brand") == c("b")) & (c("partner") == F.concat(c("base"), F.lit("_random"))), "left").select("p_brand", "base", "partner")


def semi(spark, root):
    return table(spark, root, "orders").join(table(spark, root, "lineitem").filter("l_discount > 0.09"), c("o_orderkey") == c("l_orderkey"), "left_semi").select("o_orderkey")


def anti(spark, root):
    return table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id", "left_anti").select("doc_id")


def outer_tasks(spark, root):
    e = table(spark, root, "events")
    a = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.filter("value > 80").groupBy("user_id").agg(F.count("*").alias("b"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("a", F.lit(0)).cast("long").alias("a"), F.coalesce("b", F.lit(0)).cast("long").alias("b"))


def guide_samples(spark, root):
    """Three samples of the document's source for each document, by hash."""
    d = table(spark, root, "documents").select("doc_id", "source")
    h = F.md5(F.concat(c("doc_id").cast("string"), F.lit("|7")).cast("binary"))
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(h, "doc_id"))).filter("r <= 3").select("source", c("doc_id").alias("sample_id"), c("r").cast("long").alias("r"))
    return d.join(ranked, "source").select("doc_id", "sample_id", "r")


def instruction(spark, root):
    p = table(spark, root, "part")
    first = p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("instruction"))
    return p.join(first, "p_brand").select("p_partkey", "instruction")


def contract(spark, root):
    o = table(spark, root, "orders")
    return C.violations(o, "o_orderkey", {"price": c("o_totalprice").between(0, 300000), "status": c("o_orderstatus").isin("O", "F"), "priority": F.length(F.trim("o_orderpriority")) > 0})


def sequences(spark, root):
    f = frames(spark, root).filter("event_id % 97 <> 0")
    return C.broken_sequences(f, "episode", "frame").select("episode", "n", "lo", "hi")


def gate(spark, root):
    d = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id", "left")
    ok, bad, other = C.gate(d, F.when(c("quality") == 1, "accepted").when(c("quality") == 0, "quarantined"))
    n = lambda x, s: x.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).select(F.lit(s).alias("part"), "n", "first")
    return n(ok, "accepted").unionByName(n(bad, "quarantined")).unionByName(n(other, "violation"))


def ambiguous(spark, root):
    d = table(spark, root, "documents")
    return C.ambiguous(d, "source", "lang").select(c("source").alias("key"), "n").unionByName(C.duplicates(d, "text").select(F.md5(c("text").cast("binary")).alias("key"), "n"))


def chains(spark, root):
    t = table(spark, root, "conversations").withColumn("complete", F.length("text") > 60)
    units = W.chain(t, "conv_id", "turn", "turn").withColumn("complete", F.lit(True))
    return C.complete_chains(units, t.select("conv_id", c("turn").alias("id"), "complete"), "conv_id")


def json_keys(spark, root):
    e = table(spark, root, "events")
    return e.groupBy(C.exact_keys(c("props"), ["k"]).alias("exact"), C.exact_keys(c("props"), ["k", "x"]).alias("other")).agg(F.count("*").alias("n"))


def paths(spark, root):
    p = table(spark, root, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1).alias("path"))
    return p.select("page_id", C.safe_path(c("path")).alias("absolute"), C.safe_path(F.expr("substring(path, 2)")).alias("relative"))


def finite(spark, root):
    e = table(spark, root, "embeddings")
    return e.select("vec_id", F.forall(V.doubles(c("embedding")), lambda v: ~F.isnan(v) & v.between(-0.3, 0.3)).alias("good"))


def success_paths(spark, root):
    return table(spark, root, "pages").filter(c("url").rlike("^.*page.*$")).select("page_id")


def prefix_masks(spark, root):
    f = frames(spark, root).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("frame", (c("value") < 60).alias("m")))).alias("s"))
    return f.select("episode", V.is_prefix_mask(c("s.m")).alias("prefix"))


def bijection(spark, root):
    """Differences between the frames there are and those there should be."""
    f = frames(spark, root).filter("event_id % 500 <> 3").select("episode", "frame")
    n = frames(spark, root).groupBy("episode").agg(F.count("*").alias("n")).select("episode", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)).alias("frame"))
    return C.differences(n, f)


def integrity(spark, root):
    d, x = table(spark, root, "documents").select("doc_id"), table(spark, root, "labels").select("doc_id").withColumn("l", F.lit(1))
    j = d.withColumn("d", F.lit(1)).join(x, "doc_id", "full_outer")
    return j.agg(F.count("d").alias("documents"), F.count("l").alias("labels"), F.count_if(c("l").isNull()).alias("unlabelled"), F.count_if(c("d").isNull()).alias("orphans"))


def null_language(spark, root):
    d = table(spark, root, "documents")
    return d.filter(c("lang").isNotNull() & (c("lang") != "null")).groupBy("lang").agg(F.count("*").alias("n"))


def dimension(spark, root):
    names = F.lower(F.regexp_replace("event_type", "[ _]", "-"))
    alias = F.coalesce(F.element_at(F.create_map(F.lit("purchase"), F.lit("buy"), F.lit("signup"), F.lit("join")), names), names)
    return table(spark, root, "events").filter(alias.isin("buy", "join", "view")).groupBy(alias.alias("kind")).agg(F.count("*").alias("n"))


def complete_stats(spark, root):
    s = table(spark, root, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp(F.when(c("value") > 70, c("value"))).alias("std"))
    return s.select("user_id", (c("mean").isNotNull() & c("std").isNotNull()).alias("valid"))


def resume(spark, root):
    o = table(spark, root, "orders").select("o_orderkey")
    done = table(spark, root, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    left = table(spark, root, "orders").filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    return o.join(done.union(left).distinct(), "o_orderkey", "left_anti")


QUERIES = [
    ("j04_j05_interval", interval, "WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, CAST(sum(n) OVER (ORDER BY l_orderkey) AS BIGINT) - n AS lo, CAST(sum(n) OVER (ORDER BY l_orderkey) AS BIGINT) AS hi FROM p) SELECT event_id, l_orderkey, event_id * 5 - lo AS local FROM events JOIN r ON event_id * 5 >= lo AND event_id * 5 < hi"),
    ("j04_f11_allow_list", interval_semi, f"WITH {FRAMES} SELECT event_id FROM f WHERE CASE WHEN episode % 2 = 0 THEN frame >= 5 AND frame < 20 ELSE frame >= 30 AND frame < 33 END"),
    ("j06_asof", asof_signup, "SELECT p.event_id, s.event_id AS signup_id, s.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts"),
    ("j06_s12_nearest", nearest_view, "WITH x AS (SELECT p.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS r FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase') SELECT event_id, view_id FROM x WHERE r = 1"),
    ("w18_w19_interpolated", interpolated, """
        WITH p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type = 'view'),
        a AS (SELECT p.event_id, arg_max(v.value, v.t) AS va, max(v.t) AS ta FROM p JOIN v ON v.user_id = p.user_id AND v.t <= p.t GROUP BY 1), b AS (SELECT p.event_id, arg_min(v.value, v.t) AS vb, min(v.t) AS tb FROM p JOIN v ON v.user_id = p.user_id AND v.t >= p.t GROUP BY 1)
        SELECT p.event_id, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va WHEN tb > ta THEN va + (vb - va) * (t - ta) / (tb - ta) ELSE va END, 5) AS v FROM p LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)"""),
    ("j01_unit_boundaries", unit_boundaries, "WITH u AS (SELECT conv_id, row_number() OVER w - 1 AS unit, turn AS before, lead(turn) OVER w AS after, role AS role_before, lead(role) OVER w AS role_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM u WHERE after IS NOT NULL"),
    ("j02_j03_lookup", lookup, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    ("j07_u03_run_keys", run_keys, "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'"),
    ("j08_partners", partners, "WITH p AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT a.p_brand, a.p_type AS base, b.p_type AS partner FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND b.p_type = a.p_type || '_random' WHERE a.p_type LIKE 'ECONOMY%'"),
    ("j09_semi", semi, "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)"),
    ("j10_u05_anti", anti, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    ("j11_u06_outer", outer_tasks, "WITH a AS (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, count(*) AS b FROM events WHERE value > 80 GROUP BY 1) SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (user_id)"),
    ("j13_j14_guide_samples", guide_samples, "WITH r AS (SELECT source, doc_id AS sample_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|7'), doc_id) AS r FROM documents) SELECT d.doc_id, sample_id, r FROM documents d JOIN r USING (source) WHERE r <= 3"),
    ("j15_j16_instruction", instruction, "WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS instruction FROM part GROUP BY 1) SELECT p_partkey, instruction FROM part JOIN f USING (p_brand)"),
    ("f05_f07_contract", contract, "SELECT o_orderkey AS key, 'price' AS reason FROM orders WHERE NOT o_totalprice BETWEEN 0 AND 300000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"),
    ("f08_sequences", sequences, f"WITH {FRAMES}, p AS (SELECT episode, count(*) AS n, min(frame) AS lo, max(frame) AS hi FROM f WHERE event_id % 97 <> 0 GROUP BY 1) SELECT * FROM p WHERE lo <> 0 OR hi <> n - 1"),
    ("f02_gate", gate, "SELECT CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'quarantined' ELSE 'violation' END AS part, count(*) AS n, min(doc_id) AS first FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    ("f03_s02_ambiguous", ambiguous, "SELECT source AS key, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1 UNION ALL SELECT md5(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1"),
    ("f04_chains", chains, "WITH u AS (SELECT conv_id, length(text) > 60 AS b, lead(length(text) > 60) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) SELECT conv_id, count(*) AS units, bool_and(a AND b) AS accepted FROM u WHERE a IS NOT NULL GROUP BY 1"),
    ("f05_json_keys", json_keys, "SELECT list_sort(json_keys(props)) = ['k'] AS exact, list_sort(json_keys(props)) = ['k', 'x'] AS other, count(*) AS n FROM events GROUP BY 1, 2"),
    ("f20_paths", paths, "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) AS path FROM pages) SELECT page_id, length(path) > 0 AND NOT regexp_matches(path, '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)|\\\\') AS absolute, length(substr(path, 2)) > 0 AND NOT regexp_matches(substr(path, 2), '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)|\\\\') AS relative FROM p"),
    ("f09_finite", finite, "WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, bool_and(x BETWEEN -0.3 AND 0.3) AS good FROM e GROUP BY 1"),
    ("f10_success_paths", success_paths, "SELECT page_id FROM pages WHERE url LIKE '%page%'"),
    ("f22_prefix_masks", prefix_masks, f"WITH {FRAMES}, m AS (SELECT episode, value < 60 AS m, lag(value < 60) OVER (PARTITION BY episode ORDER BY frame) AS p FROM f) SELECT episode, NOT bool_or(m AND NOT coalesce(p, true)) AS prefix FROM m GROUP BY 1"),
    ("f21_f24_bijection", bijection, f"WITH {FRAMES} SELECT episode, frame, 'left' AS side FROM f WHERE event_id % 500 = 3"),
    ("f24_u04_integrity", integrity, "SELECT count(d.doc_id) AS documents, count(l.doc_id) AS labels, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS orphans FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"),
    ("f16_null_language", null_language, "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> 'null' GROUP BY 1"),
    ("f26_dimension", dimension, "SELECT CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'join' ELSE event_type END AS kind, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1"),
    ("f23_complete_stats", complete_stats, "SELECT user_id, avg(value) IS NOT NULL AND stddev_samp(value) FILTER (value > 70) IS NOT NULL AS valid FROM events GROUP BY 1"),
    ("f25_resume", resume, "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'"),
]
