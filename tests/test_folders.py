import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.plans import catalog
from strandline.sources import folders, sinks, storage



def test_episode_folders_are_read_without_discovery(spark, tmp_path, monkeypatch):
    """Spark's discovery of partitions takes time by the square of the folders."""
    df = catalog.queries()["k07_indexed_episodes"](spark, "/root/testdata/sf0.001")
    assert "parquet_folders" in df._jdf.queryExecution().optimizedPlan().toString()
    sinks.episode_files(spark.range(40).selectExpr("id episode", "id + 1 frame"), str(tmp_path / "f"))
    monkeypatch.setattr(storage, "mounted", lambda *_: None)  # a store that is not mounted
    df = folders.read(spark, str(tmp_path / "f"), "frame long", "episode")
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.length() == 1 and leaves.head().relation().partitionSchema().isEmpty()
    assert sorted((r.episode, r.frame) for r in df.collect()) == [(i, i + 1) for i in range(40)]


def test_episode_folders_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    """The same folders, rows and types, and nothing through Hadoop's local file system, which starts a chmod for each file."""

    def written():
        found = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(s.getBytesWritten() for s in found if s.getScheme() == "file")

    df = spark.range(3000).selectExpr(
        "cast(if(id % 60 = 7, null, id % 60 - 3) as int) episode", "id div 60 frame", "array(id) a", "struct(cast(id as string) s, named_struct('d', cast(id / 7 as decimal(20,3))) t) r", "map('k', id) m",
        "date '1500-01-01' d", "timestamp '1850-01-01 01:02:03.456789' ts", "timestamp_ntz '1500-01-01 01:02:03' n", "binary('x') b",
    ).repartition(7)
    before = written()
    sinks.episode_files(df, str(tmp_path / "new 1"))
    assert written() == before
    with pytest.raises(FileExistsError, match="already exists"):
        sinks.episode_files(df, f"file://{tmp_path}/new 1")
    monkeypatch.setattr(folders, "serves", lambda *_: False)
    sinks.episode_files(df, str(tmp_path / "spark"))
    assert written() > before
    names = [sorted(p.name for p in (tmp_path / n).iterdir() if not p.name.startswith(".")) for n in ("new 1", "spark")]
    assert names[0] == names[1] and "episode=-3" in names[0] and "episode=__HIVE_DEFAULT_PARTITION__" in names[0]
    one, two = (spark.read.parquet(str(tmp_path / n)) for n in ("new 1", "spark"))
    assert one.dtypes == two.dtypes
    rows = [sorted(str(r) for r in x.collect()) for x in (one, two)]
    assert len(rows[0]) == 3000 and rows[0] == rows[1]
    files = "frame long, a array<long>, r struct<s: string, t: struct<d: decimal(20,3)>>, m map<string, long>, d date, ts timestamp, n timestamp_ntz, b binary"
    for mounted in (storage.mounted, lambda *_: None):
        monkeypatch.setattr(storage, "mounted", mounted)
        for n in ("new 1", "spark"):
            back = folders.read(spark, str(tmp_path / n), files, "episode").select(two.columns)
            assert sorted(map(str, back.collect())) == rows[1]


def test_rows_of_a_folder_are_written_in_bounded_groups(spark, tmp_path, monkeypatch):
    """A writer's groups hold a bounded number of rows; what failed leaves nothing to read, what was cut is refused."""
    monkeypatch.setattr(folders, "ROWS", 100)
    monkeypatch.setattr(folders.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    batch = lambda keys: pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "v": list(range(len(keys)))})
    w = folders.Writer({"path": str(tmp_path / "w"), "key": "k"})
    done = w.write(iter([batch([None] * 5 + [1] * 30), batch([]), *[batch([1] * 50)] * 5, batch([1] * 20 + [2] * 10)]))
    assert not list((tmp_path / "w").glob("k=*"))  # before the commit
    w.write(iter([batch([2, 3])]))  # a second try that does not count
    w.commit([done, None])
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["_SUCCESS", "k=1", "k=2", "k=__HIVE_DEFAULT_PARTITION__"]
    [file] = (tmp_path / "w" / "k=1").iterdir()
    held = pq.ParquetFile(file)
    assert file.name.startswith("part-00003-") and held.metadata.num_rows == 300
    assert [held.metadata.row_group(i).num_rows for i in range(held.num_row_groups)] == [130, 100, 70]
    again = folders.Writer({"path": str(tmp_path / "w"), "key": "k"})
    with pytest.raises(OSError):  # another task has the key
        again.commit([again.write(iter([batch([2])]))])
    with pytest.raises(FileExistsError):  # not in order
        again.write(iter([batch([5, 6, 5])]))
    again.abort([])
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".")]
    monkeypatch.setattr(folders, "BATCH", 40)
    r = folders.Reader(spark.range(0).selectExpr("id v", "id k").schema, {"path": str(tmp_path / "w"), "key": "k", "tasks": "2"})
    parts = r.partitions()
    assert [p.names for p in parts] == [["k=1", "k=2"], ["k=__HIVE_DEFAULT_PARTITION__"]]
    read = [list(r.read(p)) for p in parts]
    assert max(b.num_rows for bs in read for b in bs) <= 80
    got = [row for bs in read for b in bs for row in zip(b["k"].to_pylist(), b["v"].to_pylist())]
    want = [(1, i) for n in (range(5, 35), *[range(50)] * 5, range(20)) for i in n] + [(2, i) for i in range(20, 30)] + [(None, i) for i in range(5)]
    assert got == want


def test_no_episodes_are_no_rows(spark, tmp_path):
    sinks.episode_files(spark.range(0).selectExpr("id episode", "id frame"), str(tmp_path / "f"))
    assert folders.read(spark, str(tmp_path / "f"), "frame long", "episode").collect() == []
