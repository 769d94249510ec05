import pytest
from pyspark.errors import StreamingQueryException

from strandline.operators import extension as X
from strandline.streaming import events as E
from strandline.streaming import tables as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(path)
    return path


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_stream_equals_batch(spark, log, tmp_path):
    stream, batch = E.read_log(spark, log, SCHEMA, 1), spark.read.parquet(log)
    count = lambda d: d.selectExpr("event_type", "n", "round(total, 6) total", "most")
    same(count(E.run_to_end(E.stage_counts(stream), "counts", str(tmp_path / "c"), "complete")), count(E.stage_counts(batch)))
    same(E.run_to_end(E.slots(stream, "12 hours"), "slots", str(tmp_path / "s"), "complete"), E.slots(batch, "12 hours"))
    same(E.run_to_end(E.windowed(stream, "2 days", "1 day"), "windowed", str(tmp_path / "w"), "complete"), E.windowed(batch, "2 days", "1 day"))
    same(E.run_to_end(E.sessions(stream, "1 day", "60 days"), "sessions", str(tmp_path / "e"), "complete"), E.sessions(batch, "1 day"))


def test_moving_means_over_batches_and_blocks(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PLACES", 40)
    rows = {r.event_id: r for r in spark.read.parquet(log).collect()}
    order, parts = [], sorted({r._metadata.file_path for r in spark.read.parquet(log).select("_metadata").collect()})
    stream = E.read_log(spark, log, SCHEMA, 1)
    got = T.run_moving_mean(stream, "event_type", "event_id", "value", 30, 7, str(tmp_path / "m"), str(tmp_path / "mc"))
    # arrival: the file source takes files by time of change, then by path
    by_file = {}
    for r in spark.read.parquet(log).select("event_id", "_metadata.file_path", "_metadata.file_modification_time").collect():
        by_file.setdefault((r.file_modification_time, r.file_path), []).append(r.event_id)
    assert len(by_file) == len(parts) == 3
    for name in sorted(by_file):
        order += sorted(by_file[name])
    want = {}
    for kind in {r.event_type for r in rows.values()}:
        values = [rows[i].value for i in order if rows[i].event_type == kind]
        for seen in range(7, len(values) + 1, 7):
            last = values[max(0, seen - 30) : seen]
            want[kind, seen] = sum(last) / len(last)
    found = {(r.event_type, r.seen): r["mean"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_late_rows_rewrite_the_action_and_keep_the_observation(spark, tmp_path):
    kind = "event_id long, ts timestamp_ntz, user_id long, value double, part long"
    slot = "TIMESTAMP_NTZ'2024-01-01 0"
    for part, rows in enumerate([["(1L, {}1:00:00', 1L, 5D)"], ["(2L, {}2:00:00', 1L, 6D)", "(9L, {}9:00:00', 1L, 1D)"], ["(3L, {}0:30:00', 1L, 7D)"]]):
        values = ", ".join(r.format(slot) for r in rows)
        spark.sql(f"SELECT *, {part}L AS part FROM VALUES {values} AS t(event_id, ts, user_id, value)").coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    held = T.Batches(spark, str(tmp_path / "slots"), "user_id long, slot struct<start timestamp, end timestamp>, observation double, action double, n long")
    T.upsert(E.slots(stream, "4 hours", "1 day", ("part", "event_id")), held, str(tmp_path / "lc"))
    rows = lambda: sorted((r.observation, r.action, r.n) for r in held.latest(["user_id", "slot"]).collect())
    assert rows() == [(1.0, 1.0, 1), (5.0, 7.0, 3)]
    assert held.read().count() == 4  # changed slots only
    held.compact(["user_id", "slot"])
    assert rows() == [(1.0, 1.0, 1), (5.0, 7.0, 3)] and held.read().count() == 2


def test_attempts_survive_an_interrupted_batch(spark, tmp_path):
    for part in ([1, 2, 3], [4, 1], [5]):
        spark.createDataFrame([(i,) for i in part], "doc long").coalesce(1).write.mode("append").parquet(str(tmp_path / "work"))
    work = spark.readStream.schema("doc long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "work"))
    tried = []

    def attempt(due):
        tried.append(sorted((r.doc, r.attempt) for r in due.collect()))
        return due.selectExpr("doc", "CASE WHEN doc = 2 AND attempt < 3 THEN 'technical' WHEN doc = 4 THEN 'rejected' ELSE 'accepted' END AS status")

    class Stops(T.Batches):
        def write(self, rows, number):
            super().write(rows, number)
            if number == 1:
                raise InterruptedError

    table = (spark, str(tmp_path / "outcomes"), "doc long, attempts long, status string")
    with pytest.raises(StreamingQueryException):
        T.run_attempts(work, "doc", attempt, Stops(*table), str(tmp_path / "wc"))
    out = T.run_attempts(work, "doc", attempt, T.Batches(*table), str(tmp_path / "wc"))
    assert tried == [[(1, 1), (2, 1), (3, 1)], [(2, 2), (4, 1)], [(2, 2), (4, 1)], [(2, 3), (5, 1)]]
    assert {r.doc: (r.attempts, r.status) for r in out.collect()} == {1: (1, "accepted"), 2: (3, "accepted"), 3: (1, "accepted"), 4: (1, "rejected"), 5: (1, "accepted")}


def test_resume(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "doc long")
    done = spark.createDataFrame([(1, "accepted"), (2, "technical")], "doc long, status string")
    assert sorted(r.doc for r in E.resumed(work, done, "doc").collect()) == [2, 3]


def test_registry_and_external_calls(spark):
    reg = X.Registry("transform")

    @reg.register("double")
    def double(df):
        return df.selectExpr("id", "v * 2 as v")

    with pytest.raises(ValueError):
        reg.register("double")(double)
    with pytest.raises(KeyError):
        reg.get("other")
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert X.pipeline(reg, ["double", "double"])(df).first().v == 8.0
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad")], "id long, t string")
    assert {r.id: r.answer for r in X.external_calls(texts, "id", "t").collect()} == {1: "mock:3", 2: "mock:0", 3: "mock:3"}

    def fails(text):
        if text == "bad":
            raise TimeoutError
        return text

    got = {r.id: (r.answer, r.tries, r.error) for r in X.external_calls(texts, "id", "t", fails).collect()}
    assert got == {1: ("abc", 1, None), 2: ("", 1, None), 3: (None, 3, "TimeoutError")}
