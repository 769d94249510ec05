import json

import pytest

from strandline.operators import contracts as C
from strandline.plans import catalog
from strandline.sources import files, sinks


def test_jsonl_reports_every_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2\n[1]\n{"id": 3, "t": "y", "z": 1}\n{"id": 4, "t": null}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 5, "t": "q"}')
    good, bad = files.jsonl(spark, str(tmp_path), "id long, t string", ["id", "t"])
    assert sorted((r.id, r._line) for r in good.collect()) == [(1, 1), (4, 6), (5, 1)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(2, "blank line"), (3, "bad JSON"), (4, "no object"), (5, "wrong keys")]
    with pytest.raises(ValueError, match="contract broken"):
        C.assert_valid(bad)
    assert files.one_record_files(good).count() == 1
    index = files.row_counts(good)
    assert files.index_is_fresh(index, good) and not files.index_is_fresh(index, good.filter("id < 5"))


def test_info_tasks_and_episodes(spark, tmp_path):
    (tmp_path / "info.json").write_text(json.dumps({"fps": 25, "total_episodes": 2}, indent=1))
    _, bad = files.info(spark, str(tmp_path / "info.json"), {"fps": 25, "total_episodes": 3, "total_tasks": 1})
    assert sorted(r.reason for r in bad.collect()) == ["total_episodes", "total_tasks"]
    table, wrong = files.tasks(spark.createDataFrame([(0, "push"), (1, "pull"), (2, " "), (3, "push")], "task_index int, task_description string"))
    assert sorted((r.task_index, r.reason) for r in wrong.collect()) == [(0, "repeated"), (2, "blank"), (3, "repeated")]
    meta = [(1, ["pull"], 50, 50, 100, 2.0, 4.0), (0, ["push"], 50, 0, 50, 0.0, 2.0), (2, ["lift"], 10, 100, 111, 4.0, 9.0), (3, ["pull", "push"], 5, 111, 116, 0.0, 0.2)]
    rows = spark.createDataFrame(meta, "episode_index long, tasks array<string>, length long, dataset_from_index long, dataset_to_index long, from_timestamp double, to_timestamp double")
    got, bad = files.episodes(rows, table.filter("task_index < 2"), 25.0, "lift")
    assert [r.episode_index for r in got.collect()] == [0, 1, 3]
    assert sorted((r.key, r.reason) for r in bad.collect()) == [(2, "bounds"), (2, "duration"), (2, "known task"), (3, "one task")]


def test_states_results_logs_and_discovery(spark, tmp_path):
    frames = spark.createDataFrame([(0, 1, [0.0] * 6 + [0.5, 1.0]), (0, 0, [0.0] * 6 + [0.25, 2.0]), (1, 0, [9.0] * 8)], "episode_index long, frame_index long, state array<double>")
    assert [r.left for r in files.state_columns(frames, 0, {"left": 6, "right": 7}).collect()] == [0.25, 0.5]
    at = tmp_path / "pick" / "pol" / "arm" / "7_x" / "20240101"
    at.mkdir(parents=True)
    (at / "result.json").write_text(json.dumps({"details": {"0": {"score": 1.0}, "12": {"score": 0.25}}}))
    got = sorted(tuple(r) for r in files.evaluation_results(spark, f"{tmp_path}/*/*/*/*/*/result.json").collect())
    assert got == [("pick", "pol", "arm", 7, "20240101", 0, 1.0), ("pick", "pol", "arm", 7, "20240101", 12, 0.25)]
    (tmp_path / "log.txt").write_text("x\ncheckpoints/steps_500_run2 -> Average success: 0.75\n")
    assert tuple(files.success_lines(spark, str(tmp_path / "log.txt")).first()) == (500, 2, 0.75)
    (tmp_path / "sets" / "a" / "meta").mkdir(parents=True)
    (tmp_path / "sets" / "a" / "meta" / "info.json").write_text("{}")
    assert files.discover(spark, str(tmp_path / "sets")).first().dataset.endswith("/sets/a")
    (tmp_path / "t.csv").write_text("set_index,text\n1,a\n")
    assert files.csv(spark, str(tmp_path / "t.csv"), "set_index int, text string").first().text == "a"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Pick Up!", 3, 0, 1.0), ("Pick Up!", 3, 1, 2.0), ("Go", 4, 0, 3.0)], "task string, episode int, frame int, v double")
    sinks.build_artifacts(str(tmp_path / "a"), documents=df)
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.build_artifacts(str(tmp_path / "a"), documents=df)
    sinks.document_files(df, str(tmp_path / "d"))
    assert (tmp_path / "d" / "task=pick-up" / "episode=0000003").is_dir()
    assert sorted(r["index"] for r in sinks.with_global_index(df, "episode", "frame").collect()) == [0, 1, 2]
    sinks.append_events(df, str(tmp_path / "e"))
    sinks.append_events(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 6
    sinks.episode_files(df, str(tmp_path / "f"))
    sinks.tensors(df, str(tmp_path / "t"), {"version": "1"})
    assert spark.read.parquet(str(tmp_path / "t")).first().metadata == {"version": "1"}
    sinks.summary(df, str(tmp_path / "s"))
    sinks.convert(df, {"state": "array(v)", "episode_index": "cast(episode as long)"}, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["state", "episode_index"]


def test_small_files_are_spread_over_tasks(spark, tmp_path):
    df = spark.range(40).selectExpr("'Go' task", "id episode", "0L frame", "id / 2 balance")
    sinks.document_files(df, str(tmp_path / "d"))
    names = [p.name for p in (tmp_path / "d").glob("*/*/*.json")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 4  # task numbers


def test_lines_are_read_once_and_numbered_in_files_of_any_size(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"i={i}").mkdir()
        (tmp_path / f"i={i}" / "a.jsonl").write_text("".join(f'{{"id": {j}}}\n' for j in range(1, i + 1)) + "x\n" * (i == 3))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    for whole in (4 << 20, 100, 0):  # all files at once, some, each in parts
        monkeypatch.setattr(files, "WHOLE", whole)
        lines = files.checked_lines(spark, str(tmp_path), "id long", ["id"])
        got = [(r._line, r.r and r.r.id, r.reason) for r in lines.collect()]
        assert len(got) == 781 and all(line == n for line, n, reason in got if not reason)
        assert [g for g in got if g[2]] == [(4, None, "bad JSON")]
        assert files.one_record_violations(lines) == 39  # 38 files of several records, a bad line
    assert spark.conf.get(key) == before


def test_episodes_are_spread_over_tasks(spark, tmp_path):
    sinks.episode_files(spark.range(40).selectExpr("id episode", "0L frame"), str(tmp_path / "f"))
    names = [p.name for p in (tmp_path / "f").glob("*/*.parquet")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 4  # task numbers


def test_json_lines_query_reads_its_files_in_one_pass(spark):
    """One scan of small files and two of large ones; a scan for each of records and violations doubled that."""
    df = catalog.queries()["s08_s21_json_lines"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [") <= 3
