"""The stateful call budget: frames, batches, restarts, a raised limit and renewal by event time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import budget as B
from strandline.streaming import events as E

KIND = "id long, who string, at timestamp"


class Log:
    def __init__(self, spark, tmp):
        self.spark, self.tmp, self.parts = spark, tmp, 0

    def add(self, rows):
        self.parts += 1
        self.spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(self.tmp / f"log/part={self.parts}"))

    def run(self, limit, **more):
        calls = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(self.tmp / "log"))
        if more:
            calls = calls.withWatermark("at", "0 seconds")
        with B.state_on_disk(self.spark):
            return E.run_to_table(B.call_budget(calls, "who", "id", limit, **more), str(self.tmp / "out"), str(self.tmp / "checkpoint"))


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


T0 = datetime.datetime(2024, 1, 1)


def test_frames_batches_and_restarts(spark, log):
    rng = random.Random(1)
    ids = list(range(25_000))
    rng.shuffle(ids)
    log.add([(i, "a", T0) for i in ids])  # many frames of one key, shuffled
    log.add([(30_000 + i, w, T0) for i in range(40) for w in "ab"])
    first = log.run(50)
    log.add([(40_000 + i, w, T0) for i in range(40) for w in "ab"])
    out = {(r.who, r.id): (r.call, r.status) for r in log.run(50).collect()}
    assert first.count() == 25_080
    assert {k: v for k, v in out.items() if v[1] == "reserved"} == {
        **{("a", i): (i + 1, "reserved") for i in range(50)},
        **{("b", 30_000 + i): (i + 1, "reserved") for i in range(40)},
        **{("b", 40_000 + i): (41 + i, "reserved") for i in range(10)},
    }
    assert len(out) == 25_160 and all(v[0] is None for v in out.values() if v[1] == "exhausted")


def test_exhausted_calls_stay_pending_until_the_limit_rises(spark, log):
    log.add([(i, "a", T0) for i in range(8)])
    work = spark.range(10).withColumnRenamed("id", "id")
    out = log.run(5)
    assert sorted(r.id for r in B.left_to_do(work, out, "id").collect()) == [5, 6, 7, 8, 9]
    log.add([(9, "a", T0), (8, "a", T0)])
    rows = log.run(7).filter("status = 'reserved'").collect()
    assert {r.id: r.call for r in rows} == {i: i + 1 for i in range(7)}
    log.add([(10, "a", T0)])
    rows = log.run(20).filter("status = 'reserved'").collect()
    assert {r.id: r.call for r in rows} == {i: i + 1 for i in range(11)}  # 7 to 9 waited, 10 comes after them


def test_a_period_renews_the_budget(spark, log):
    minute = datetime.timedelta(minutes=1)
    log.add([(i, "a", T0) for i in range(5)])
    log.add([(100, "b", T0 + 30 * minute)])
    log.add([(101, "b", T0 + 61 * minute)])
    out = log.run(3, period_ms=30 * 60_000, time="at").filter("who = 'a'")
    rows = sorted((r.id, r.call, r.status) for r in out.filter(F.col("status") == "reserved").collect())
    assert rows == [(0, 1, "reserved"), (1, 2, "reserved"), (2, 3, "reserved"), (3, 1, "reserved"), (4, 2, "reserved")]
