"""Sources and sinks: driver tables are written in the format at hand, read back by the library and reported on."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.plans.common import FRAMES, frames, fresh_folder
from strandline.sources import counts, files, folders, mcap, sinks, storage, tfrecord, vqa
from strandline.sources.snapshots import SnapshotTable
from strandline.sources.tables import table

c = F.col


def put(spark, path, text):
    """A small file under a name that Spark itself would not give."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(text.encode())
    out.close()


def metadata(spark, root):
    """Orders as episodes: a priority is the task, lines are frames; every 13th length and every 17th time is wrong."""
    n = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, root, "orders").join(n, c("o_orderkey") == c("l_orderkey"))
    key = c("o_orderkey")
    tasks = F.when(key % 11 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderpriority"))
    return o.select(
        key.alias("episode_index"), tasks.alias("tasks"), (c("n") + F.when(key % 13 == 0, 1).otherwise(0)).alias("length"), (key * 10).alias("dataset_from_index"), (key * 10 + c("n")).alias("dataset_to_index"),
        F.lit(1.0).alias("from_timestamp"), (1.0 + c("n") / 10 + F.when(key % 17 == 0, 0.5).otherwise(0.0)).alias("to_timestamp"),
    )


def episodes(spark, root):
    """Episodes that are read back from Parquet, with what each of them breaks; one kind of task is left out."""
    at = fresh_folder(spark, "episodes")
    metadata(spark, root).write.parquet(at)
    known, _ = files.tasks(table(spark, root, "orders").select(c("o_orderpriority").alias("task")).distinct().filter("task <> '2-HIGH'").select("task", F.ascii("task").alias("task_index")))
    kept, broken = files.episodes(spark.read.parquet(at), known, 10.0, "low")
    reasons = broken.groupBy(c("key").alias("episode_index")).agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))
    return kept.join(reasons, "episode_index", "left").select("episode_index", "text", "task_index", F.coalesce("reasons", F.lit("")).alias("reasons"))


def states(spark, root):
    """Two named dimensions of one episode's states; the episode's filter reaches the scan."""
    at = fresh_folder(spark, "states")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    table(spark, root, "embeddings").select(c("label").alias("episode_index"), place.alias("frame_index"), c("embedding").alias("state")).write.parquet(at)
    rows = files.state_columns(spark.read.parquet(at), 3, {"left": 6, "right": 13})
    return rows.select(c("frame_index").cast("long").alias("frame_index"), *[F.round(c(n).cast("double"), 6).alias(n) for n in ("left", "right")])


def info(spark, root):
    """Counts of the tables as one JSON document and the contract that it breaks."""
    at = fresh_folder(spark, "info")
    o = table(spark, root, "orders").agg(F.count("*").alias("total_episodes"), F.countDistinct("o_orderpriority").alias("total_tasks"))
    put(spark, f"{at}/info.json", json.dumps(o.first().asDict() | {"fps": 25}, indent=1))
    _, broken = files.info(spark, f"{at}/info.json", {"fps": 25, "total_tasks": 4, "robot": "arm"})
    found = files.discover_text(spark, f"{at}/info.json").select(F.get_json_object("content", "$.total_episodes").cast("long").alias("total_episodes"))
    return found.crossJoin(broken.agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons")))  # one row each


def json_lines(spark, root):
    """Lines of a file per user, some of them bad: what is wrong, where, and the records between."""
    at = fresh_folder(spark, "jsonl")
    e = table(spark, root, "events")
    good = F.concat(F.lit('{"id": '), c("event_id").cast("string"), F.lit(', "kind": "'), c("event_type"), F.lit('"}'))
    k = c("event_id") % 50
    line = F.when(k == 1, "").when(k == 2, '{"id": 1').when(k == 3, "[1]").when(k == 4, '{"id": 1, "kind": "x", "more": 2}').otherwise(good)
    e.select("user_id", "event_id", line.alias("value")).transform(sinks.by_folder, "user_id").sortWithinPartitions("user_id", "event_id").drop("event_id").write.partitionBy("user_id").text(at)
    lines = files.checked_lines(spark, at, "id long, kind string", ["id", "kind"])
    user = F.regexp_extract("_file", r"user_id=(\d+)/", 1).cast("long")
    return lines.select(user.alias("user_id"), c("_line").alias("line"), "r.kind", "reason")


def counted(spark, root):
    """Row counts of a file per customer nation against an index that is stale for every fifth of them."""
    at = fresh_folder(spark, "counted")
    table(spark, root, "customer").select("c_nationkey", F.to_json(F.struct("c_custkey")).alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(at)
    records, _ = files.jsonl(spark, at, "c_custkey long")
    rows = files.row_counts(records).withColumn("nation", F.regexp_extract("_file", r"c_nationkey=(\d+)/", 1).cast("long"))
    index = rows.select("nation", (c("rows") + (c("nation") % 5 == 0).cast("int")).alias("indexed"))
    return rows.join(index, "nation").select("nation", "rows", (c("rows") == c("indexed")).alias("fresh"))


def document_files(spark, root):
    """A file per supplier, in folders by task slug and episode; each holds one record."""
    at = fresh_folder(spark, "documents")
    sinks.document_files(table(spark, root, "supplier").select(F.concat(F.lit("Nation No. "), "s_nationkey").alias("task"), c("s_suppkey").alias("episode"), c("s_acctbal").alias("balance")), at)
    lines = files.checked_lines(spark, f"{at}/*/*", "balance double")
    many = files.one_record_violations(lines)
    part = lambda name: F.regexp_extract("_file", rf"{name}=([^/]+)/", 1)
    return lines.filter("reason is null").select(part("task").alias("task"), part("episode").alias("episode"), "r.balance", F.lit(many).cast("long").alias("violations"))


def results(spark, root):
    """Scores of nations as evaluation results: the path tells task, policy, embodiment, seed and time."""
    at = fresh_folder(spark, "results")
    per = table(spark, root, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for region in sorted({r.n_regionkey for r in per}):
        details = {str(r.n_nationkey): {"score": r.n_nationkey / 25} for r in per if r.n_regionkey == region}
        put(spark, f"{at}/task{region}/pol/arm/{region}_s/2024010{region}/result.json", json.dumps({"details": details}))
    return files.evaluation_results(spark, f"{at}/*/*/*/*/*/result.json")


def reports(spark, root):
    """A report written as CSV and as JSON, both read back."""
    at = fresh_folder(spark, "reports")
    n = table(spark, root, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    sinks.summary(n, f"{at}/csv")
    sinks.summary(n, f"{at}/json", "json")
    again = files.csv(spark, f"{at}/csv", "o_orderpriority string, n long")
    return again.join(spark.read.schema("o_orderpriority string, n long").json(f"{at}/json"), ["o_orderpriority", "n"])


def log_lines(spark, root):
    """Success lines among other lines of a log."""
    at = fresh_folder(spark, "log")
    e = table(spark, root, "events")
    # format_string rounds the shortest digits, format_number the binary value, as printf does
    rate = F.expr("format_number(value / 100, '0.00')")
    line = F.when(c("event_id") % 4 == 0, F.format_string("checkpoints/steps_%d_run%d -> Average success: %s", c("event_id") * 500, c("user_id"), rate)).otherwise(F.concat(F.lit("steps_1 loss "), c("value").cast("string")))
    e.select(line.alias("value")).write.text(at)
    return files.success_lines(spark, at)


def discovered(spark, root):
    at = fresh_folder(spark, "sets")
    for r in table(spark, root, "region").collect():  # 5 rows
        put(spark, f"{at}/{r.r_name.lower().replace(' ', '-')}/meta/info.json", json.dumps({"key": r.r_regionkey}))
    found = files.discover(spark, at)
    return found.select(F.regexp_extract("dataset", "([^/]+)$", 1).alias("dataset"), F.get_json_object("content", "$.key").cast("long").alias("key"))


def artifacts(spark, root):
    """Build artifacts as JSON lines, read back; building them again into the same place is refused."""
    at = fresh_folder(spark, "artifacts")
    parts = {"dataset": table(spark, root, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name")), "episodes": table(spark, root, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"))}
    sinks.build_artifacts(at, **parts)
    try:
        sinks.build_artifacts(at, **parts)
        refused = False
    except Exception as e:
        refused = "already exists" in str(e).lower()
    read = [spark.read.schema("id long, name string").json(f"{at}/{name}.jsonl").select(F.lit(name).alias("part"), "id", "name", F.lit(refused).alias("refused")) for name in parts]
    return read[0].unionByName(read[1])


def appended(spark, root):
    at = fresh_folder(spark, "events")
    e = table(spark, root, "events").select("event_id", "event_type", "value")
    for part in range(3):
        sinks.append_events(e.filter(c("event_id") % 3 == part), at)
    return spark.read.schema("event_id long, event_type string, value double").json(at)


def tensors(spark, root):
    at = fresh_folder(spark, "tensors")
    sinks.tensors(table(spark, root, "embeddings").select("vec_id", "embedding"), at, {"version": "7"})
    t = spark.read.parquet(at)
    return t.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.element_at("metadata", "version").alias("version"))


def indexed_episodes(spark, root):
    """Episode files with a global frame index."""
    at = fresh_folder(spark, "frames")
    sinks.episode_files(sinks.with_global_index(frames(spark, root).select("episode", "frame", "event_id"), "episode", "frame"), at)
    return folders.read(spark, at, "frame long, event_id long, index long", "episode").select("episode", "frame", "event_id", "index")


def converted(spark, root):
    at = fresh_folder(spark, "converted")
    sinks.convert(table(spark, root, "supplier"), {"episode_index": "s_suppkey", "state": "array(s_acctbal, s_acctbal / 2)", "task": "lower(s_name)"}, at)
    return spark.read.parquet(at).select("episode_index", F.round(F.get("state", F.lit(1)), 4).alias("half"), "task")


def moved_stats(spark, root):
    """Statistics of each episode as JSON lines, read back."""
    at = fresh_folder(spark, "stats")
    sinks.moved_stats(frames(spark, root), at, "episode", ["value"])
    s = spark.read.schema("episode long, stats struct<value:struct<min:double,max:double,mean:double,std:double,count:long>>").json(at)
    return s.select("episode", *[F.round(c(f"stats.value.{n}"), 6).alias(n) for n in ("min", "max", "mean", "std")], c("stats.value.count").alias("n"))


def tracker(spark, root):
    """Metrics of two runs; the second logs every tenth step again, and the last value counts."""
    at = fresh_folder(spark, "metrics")
    e = table(spark, root, "events").select((c("event_id") % 200).alias("step"), c("event_type").alias("name"), "value", "event_id")
    m = e.groupBy("step", "name").agg(F.max("value").alias("value"))
    sinks.track(m, at, "a")
    sinks.track(m, at, "b")
    sinks.track(m.filter("step % 10 = 0").withColumn("value", c("value") + 1), at, "b")
    logged = spark.read.schema("run string, step long, name string, value double, at timestamp").json(at)
    return sinks.tracked(logged).select("run", "step", "name", F.round("value", 6).alias("value"))


def snapshots(spark, root):
    """Events appended by three threads at once; a version that was pinned before everything was replaced still reads."""
    t = SnapshotTable(spark, fresh_folder(spark, "snapshots"))
    e = table(spark, root, "events").select("event_id", "event_type", "value")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda part: t.append(e.filter(c("event_id") % 6 == part), token=(f"part{part}", 0)), range(6)))
    t.append(e.filter(c("event_id") % 6 == 0), token=("part0", 0))  # a repetition adds nothing
    pinned = t.read(t.versions()[-1])
    t.replace(e.groupBy("event_type").agg(F.min("event_id").alias("event_id"), F.sum("value").alias("value")).select("event_id", "event_type", "value"))
    shown = lambda df, state: df.select(F.lit(state).alias("state"), "event_id", "event_type", F.round("value", 4).alias("value"))
    return shown(pinned, "appended").unionByName(shown(t.read(), "replaced"))


def tfrecord_vectors(spark, root):
    """Embeddings as TFRecord examples and back, files cut into many tasks."""
    tfrecord.register(spark)
    at = fresh_folder(spark, "tfrecord")
    table(spark, root, "embeddings").write.format("tfrecord").mode("append").save(at)
    v = spark.read.format("tfrecord").schema("vec_id long, embedding array<float>, label int").option("splitBytes", 1 << 20).load(at)
    return v.select("vec_id", "label", F.size("embedding").cast("long").alias("n"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(f"x{i}") for i in (0, 31, 63)])


def tfrecord_events(spark, root):
    at = fresh_folder(spark, "tfrecord")
    tfrecord.register(spark)
    e = table(spark, root, "events").select("event_id", F.unix_micros(c("ts").cast("timestamp")).alias("micros"), "event_type", F.when(c("user_id") % 5 > 0, c("user_id")).alias("user_id"), F.floor("value").cast("float").alias("value"), "props")
    e.repartition(storage.tasks(spark)).write.format("tfrecord").mode("append").save(at)
    return tfrecord.read_files(spark, at, "event_id long, micros long, event_type string, user_id long, value float, props string").select("event_id", "micros", "event_type", "user_id", c("value").cast("double").alias("value"), "props")


def messages(spark, root):
    """Events as messages of a topic for each type; two topics of a span of time are read, by the chunk index."""
    mcap.register(spark)
    at = fresh_folder(spark, "mcap")
    nanos = F.unix_micros(c("ts").cast("timestamp")) * 1000
    e = table(spark, root, "events").select(
        F.concat(F.lit("/"), "event_type").alias("topic"), nanos.alias("log_time"), nanos.alias("publish_time"), c("event_id").alias("sequence"), F.lit("json").alias("encoding"), F.lit("event").alias("schema"), F.encode("props", "UTF-8").alias("data")
    )
    e.repartitionByRange(4, "log_time").sortWithinPartitions("log_time", "sequence").write.format("mcap").option("chunkBytes", 16_384).mode("append").save(at)
    low, high = e.agg(F.min("log_time"), F.max("log_time")).first()
    m = spark.read.format("mcap").load(at).filter((c("log_time") >= low + (high - low) // 4) & (c("log_time") < low + (high - low) // 2) & c("topic").isin("/view", "/error"))
    return m.select("topic", F.expr("log_time div 1000").alias("micros"), c("sequence").alias("event_id"), F.decode("data", "UTF-8").alias("props"))


def incremental(spark, root):
    """Row counts of a file for each nation from an index; a third of the files is written again before the second look,
    which reads those alone."""
    at, index = fresh_folder(spark, "counted"), SnapshotTable(spark, fresh_folder(spark, "index"))
    lines = table(spark, root, "customer").select("c_nationkey", F.to_json(F.struct("c_custkey")).alias("value"))
    lines.repartition("c_nationkey").write.partitionBy("c_nationkey").text(at)
    counts.refreshed(spark, at, index)
    again = lines.filter("c_nationkey % 3 = 0").withColumn("value", F.explode(F.array("value", "value")))
    again.repartition("c_nationkey").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("c_nationkey").text(at)
    found, done = counts.refreshed(spark, at, index)
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("long")
    return found.select(nation.alias("nation"), "rows", *[F.lit(done[k]).cast("long").alias(f"files_{k}") for k in ("read", "kept", "gone")])


META = """n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
        m AS (SELECT k, n, o_orderpriority AS p, p <> '2-HIGH' AS known FROM n JOIN orders ON o_orderkey = k)"""
def questions(spark, root):
    """Parts as questions over their brand's image, which is beside the lines for some brands, under a root for others and
    missing for the rest."""
    at = fresh_folder(spark, "vqa")
    for i, r in enumerate(table(spark, root, "part").select("p_brand").distinct().orderBy("p_brand").collect()):  # 25 rows
        if i % 3 < 2:
            put(spark, f"{at}/{('set', 'root/data')[i % 3]}/{r.p_brand}.png", "x")
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("p_name").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("p_type").alias("value")))
    lines = table(spark, root, "part").select("p_partkey", F.to_json(F.struct(turns.alias("conversations"), F.concat("p_brand", F.lit(".png")).alias("image"), F.lit("data").alias("data_path"), F.col("p_partkey").cast("string").alias("source"))).alias("value"))
    lines.select("value").write.text(f"{at}/set/lines")
    found, _ = vqa.records(spark, f"{at}/set/lines")
    # several files number their lines each, the source tells the part
    found = found.withColumn("line", c("source").cast("long"))
    done, lost = vqa.resolved(found, counts.listed(spark, at, "*.png"), f"{at}/set", f"{at}/root")
    shown = done.select(c("line").alias("part"), F.regexp_extract(c("images")[0], "/(set|root)/", 1).alias("place"), c("conversations")[1]["value"].alias("answer"))
    return shown.unionByName(lost.select(c("line").alias("part"), F.lit("nowhere").alias("place"), F.lit(None).cast("string").alias("answer")))


#: The events between a quarter and half of the time.
SPAN = "n AS (SELECT min(epoch_us(ts)) * 1000 AS low, max(epoch_us(ts)) * 1000 AS high FROM events)"
QUERIES = [
    ("s20_questions", questions, "WITH b AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) % 3 AS k FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey AS part, CASE k WHEN 0 THEN 'set' WHEN 1 THEN 'root' ELSE 'nowhere' END AS place, CASE WHEN k < 2 THEN p_type END AS answer FROM part JOIN b USING (p_brand)"),
    ("k03_k04_snapshots", snapshots, "SELECT 'appended' AS state, event_id, event_type, round(value, 4) AS value FROM events UNION ALL SELECT 'replaced', min(event_id), event_type, round(sum(value), 4) FROM events GROUP BY event_type"),
    ("s16_k10_tfrecord_vectors", tfrecord_vectors, "SELECT vec_id, label, len(embedding) AS n, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS x{i}" for i in (0, 31, 63)) + " FROM embeddings"),
    ("s16_k10_tfrecord_events", tfrecord_events, "SELECT event_id, epoch_us(ts) AS micros, event_type, CASE WHEN user_id % 5 > 0 THEN user_id END AS user_id, floor(value) AS value, props FROM events"),
    ("s15_messages", messages, f"WITH {SPAN} SELECT '/' || event_type AS topic, epoch_us(ts) AS micros, event_id, props FROM events, n WHERE event_type IN ('view', 'error') AND epoch_us(ts) * 1000 >= low + (high - low) // 4 AND epoch_us(ts) * 1000 < low + (high - low) // 2"),
    ("s21_incremental_counts", incremental, "WITH k AS (SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1) SELECT nation, CAST(CASE WHEN nation % 3 = 0 THEN 2 * n ELSE n END AS BIGINT) AS rows, count(*) FILTER (nation % 3 = 0) OVER () AS files_read, count(*) FILTER (nation % 3 > 0) OVER () AS files_kept, count(*) FILTER (nation % 3 = 0) OVER () AS files_gone FROM k"),
    ("s01_o01_episodes", episodes, f"""
        WITH {META} SELECT k AS episode_index, p AS text, CASE WHEN known THEN ascii(p) END::BIGINT AS task_index,
          concat_ws(',', CASE WHEN k % 13 = 0 THEN 'bounds' END, CASE WHEN abs(n / 10 + (k % 17 = 0)::INT * 0.5 - (n + (k % 13 = 0)::INT) / 10) > 0.101 THEN 'duration' END,
                    CASE WHEN NOT known THEN 'known task' END, CASE WHEN k % 11 = 0 THEN 'one task' END) AS reasons
        FROM m WHERE p NOT LIKE '%LOW%'"""),
    ("s03_o03_states", states, "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame_index, round(CAST(embedding[7] AS DOUBLE), 6) AS \"left\", round(CAST(embedding[14] AS DOUBLE), 6) AS \"right\" FROM embeddings WHERE label = 3"),
    ("s04_info", info, "SELECT count(*) AS total_episodes, 'robot' || CASE WHEN count(DISTINCT o_orderpriority) <> 4 THEN ',total_tasks' ELSE '' END AS reasons FROM orders"),
    ("s08_s21_json_lines", json_lines, """
        WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_type, event_id % 50 AS k FROM events)
        SELECT user_id, line, CASE WHEN k NOT IN (1, 2, 3, 4) THEN event_type END AS kind, CASE k WHEN 1 THEN 'blank line' WHEN 2 THEN 'bad JSON' WHEN 3 THEN 'no object' WHEN 4 THEN 'wrong keys' END AS reason FROM l"""),
    ("s21_row_counts", counted, "SELECT c_nationkey::BIGINT AS nation, count(*) AS rows, c_nationkey % 5 <> 0 AS fresh FROM customer GROUP BY c_nationkey"),
    ("s09_k02_document_files", document_files, "SELECT 'nation-no-' || s_nationkey AS task, lpad(s_suppkey::VARCHAR, 7, '0') AS episode, s_acctbal AS balance, 0::BIGINT AS violations FROM supplier"),
    ("s22_results", results, "SELECT 'task' || n_regionkey AS task, 'pol' AS policy, 'arm' AS embodiment, n_regionkey::BIGINT AS seed, '2024010' || n_regionkey AS timestamp, n_nationkey::BIGINT AS layout_id, n_nationkey / 25 AS score FROM nation"),
    ("s23_k13_reports", reports, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    ("s24_log_lines", log_lines, "SELECT event_id * 500 AS step, user_id AS run, CAST(printf('%.2f', value / 100) AS DOUBLE) AS success FROM events WHERE event_id % 4 = 0"),
    ("s17_discovered", discovered, "SELECT replace(lower(r_name), ' ', '-') AS dataset, r_regionkey::BIGINT AS key FROM region"),
    ("k01_k03_artifacts", artifacts, "SELECT 'dataset' AS part, r_regionkey::BIGINT AS id, r_name AS name, true AS refused FROM region UNION ALL SELECT 'episodes', n_nationkey, n_name, true FROM nation"),
    ("k04_appended", appended, "SELECT event_id, event_type, value FROM events"),
    ("k05_tensors", tensors, "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, '7' AS version FROM embeddings"),
    ("k07_indexed_episodes", indexed_episodes, f"WITH {FRAMES} SELECT episode, frame, event_id, row_number() OVER (ORDER BY episode, frame) - 1 AS index FROM f"),
    ("k08_converted", converted, "SELECT s_suppkey AS episode_index, round(s_acctbal / 2, 4) AS half, lower(s_name) AS task FROM supplier"),
    ("k14_moved_stats", moved_stats, "SELECT user_id AS episode, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY 1"),
    ("k15_tracker", tracker, "WITH m AS (SELECT event_id % 200 AS step, event_type AS name, max(value) AS v FROM events GROUP BY 1, 2) SELECT 'a' AS run, step, name, round(v, 6) AS value FROM m UNION ALL SELECT 'b', step, name, round(CASE WHEN step % 10 = 0 THEN v + 1 ELSE v END, 6) FROM m"),
]
