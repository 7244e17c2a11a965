import bz2
import gzip
import json

import pytest
from conftest import TASKS, small_log, write_array, write_lines

from eventlens.plans.corpus import Corpus
from eventlens.sources import normalize, readers, tables
from eventlens.streaming import live


def test_arrays_and_lines_give_the_same_events(spark, tmp_path):
    write_array(tmp_path / "a" / "x.json", small_log())
    write_lines(tmp_path / "b" / "x.json", small_log())
    cols = ["Event", "Timestamp", "`Stage ID`", "`Task Info`", "`Task Executor Metrics`"]
    a = readers.scan_events(spark, str(tmp_path / "a")).selectExpr(*cols)
    b = readers.scan_events(spark, str(tmp_path / "b")).selectExpr(*cols)
    assert a.count() == len(small_log()) and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("peek", [True, False])
def test_format_is_found_per_file(spark, tmp_path, peek):
    write_array(tmp_path / "lead.json", small_log(), lead="\n  \n ")
    write_lines(tmp_path / "lines.json", small_log())
    with gzip.open(tmp_path / "array.json.gz", "wt") as f:
        json.dump(small_log(), f)
    got = {r.file.split("/")[-1]: r.format for r in readers.detect_format(spark, str(tmp_path), peek).collect()}
    assert got == {"lead.json": "array", "lines.json": "ndjson", "array.json.gz": "array"}


def test_malformed_and_untyped_records(spark, tmp_path):
    good = small_log()[0]
    write_lines(tmp_path / "x", [good, "not json", '{"Event": "SparkListenerTaskEnd", "Stage ID": 1}', "", '{"Timestamp": 4}'])
    for events in (readers.scan_ndjson(spark, str(tmp_path)), readers.parse_lines(readers.scan_lines(spark, str(tmp_path)))):
        assert normalize.typed(events).count() == 2
        s = normalize.parse_stats(events, keys=("file",)).collect()[0]
        assert (s.total_records, s.parsed_events, s.kept_untyped, s.missing_event, s.malformed) == (4, 1, 1, 1, 1)


def test_a_field_of_the_wrong_type_keeps_the_event_untyped(spark, tmp_path):
    bad = dict(small_log()[0], Timestamp="yesterday")
    write_lines(tmp_path / "x", [bad])
    rows = normalize.typed(readers.scan_ndjson(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and not rows[0].is_valid and rows[0]["App Name"] == "nightly"


def test_strict_mode_raises(spark, tmp_path):
    write_lines(tmp_path / "x" / "f", [small_log()[0], "not json"])
    with pytest.raises(Exception):
        readers.scan_ndjson(spark, str(tmp_path / "x"), strict=True).collect()
    write_lines(tmp_path / "y" / "f", [{"Event": "SparkListenerTaskEnd", "Stage ID": 1}])
    with pytest.raises(Exception):
        normalize.strict(readers.scan_ndjson(spark, str(tmp_path / "y"))).collect()


def test_a_loaded_corpus_keeps_every_record(spark, tmp_path):
    extra = {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Own": {"x": 5}}
    write_lines(tmp_path / "log" / "a.json", [*small_log("app-a"), extra, "not json", '{"Timestamp": 4}'])
    (tmp_path / "log" / "b.json.bz2").write_bytes(bz2.compress(json.dumps(small_log("app-b"), indent=1).encode()))
    (tmp_path / "log" / "cut.json").write_text('[{"Event": "SparkListenerApplicationEnd", "Time')
    for peek in (True, False):
        corpus = Corpus.load(spark, str(tmp_path / "log"), peek=peek)
        assert sorted(r.app_id for r in corpus.applications.collect()) == ["app-a", "app-b"]
        assert corpus.events.count() == 2 * len(small_log()) + 1 and corpus.tasks.where("app_id = 'app-b'").count() == len(TASKS)
        assert sorted((r.app_id, r.reason) for r in corpus.rejected.collect()) == [("app-a", "malformed"), ("app-a", "no event name"), ("cut", "malformed")]
        s = {r.app_id: r for r in corpus.parse_statistics.collect()}["app-a"]
        assert (s.kept_untyped, s.missing_event, s.malformed) == (1, 1, 1)
        assert corpus.load_counts == {"total_records": 2 * len(small_log()) + 4, "parsed_events": 2 * len(small_log()), "kept_untyped": 1, "missing_event": 1, "malformed": 2}
        own = corpus.events.where("NOT is_valid").selectExpr(f"{normalize.open_field('$.Own.x', 'int')} AS x").collect()
        assert [r.x for r in own] == [5]


@pytest.mark.parametrize("bad", ["not json", '{"Timestamp": 4}', '{"Event": "SparkListenerTaskEnd", "Stage ID": 1}'])
def test_strict_load_raises(spark, tmp_path, bad):
    write_lines(tmp_path / "a.json", [small_log()[0], bad])
    with pytest.raises(Exception):
        Corpus.load(spark, str(tmp_path), strict=True)


def test_rolling_log_is_one_application(spark, tmp_path):
    log = small_log("app-r")
    for folder, events in (("eventlog_v2_app-r", log), ("eventlog_v2_lost", log[1:])):
        name = folder.removeprefix("eventlog_v2_")
        write_lines(tmp_path / folder / f"events_1_{name}", events[:8])
        write_lines(tmp_path / folder / f"events_2_{name}", events[8:])
    corpus = Corpus.load(spark, str(tmp_path))
    assert sorted(r.app_id for r in corpus.applications.collect()) == ["app-r", "lost"]
    assert corpus.tasks.where("app_id = 'app-r'").count() == len(TASKS)


def test_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write("\n".join(json.dumps(e) for e in small_log()))
    assert readers.scan_gzip(spark, str(tmp_path), 3).filter("Event IS NOT NULL").count() == len(small_log())


def test_application_without_start_is_named_by_its_file(spark, tmp_path):
    write_lines(tmp_path / "nameless.json", small_log()[1:])
    apps = tables.applications(tables.attach_app_ids(readers.scan_ndjson(spark, str(tmp_path)))).collect()
    assert [a.app_id for a in apps] == ["nameless"] and apps[0].duration_ms is None


def test_stage_ids_from_stage_infos_and_time_fallback(spark, tmp_path):
    write_lines(tmp_path / "j", [
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Time": 5, "Stage Infos": [{"Stage ID": 7}, {"Stage ID": 8}]},
        {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 9, "Job Result": {"Result": "JobFailed"}}, {"Event": "SparkListenerJobStart", "Job ID": 2, "Stage IDs": [1]}])
    jobs = {r.job_id: r for r in tables.jobs(tables.attach_app_ids(readers.scan_ndjson(spark, str(tmp_path)))).collect()}
    assert jobs[1].stage_ids == [7, 8] and jobs[1].submission_ms == 5 and jobs[1].status == "FAILED" and jobs[2].status == "RUNNING"


def test_summarized_log(spark, tmp_path):
    log = {"applicationId": "app-s", "stages": [{"stageId": 3, "numTasks": 4, "executorRunTime": 1000, "gcTime": 100, "memoryBytesSpilled": 40, "taskMetrics": {"avgCpuUtilization": 0.5, "avgTaskDurationMs": 25}},
                                                {"stageId": 4, "numTasks": 0}]}
    write_array(tmp_path / "s.json", log)
    rows = readers.summarized_tasks(readers.scan_summarized(spark, str(tmp_path))).collect()
    assert len(rows) == 4 and rows[0].run_ms == 250 and rows[0].cpu_ns == 125e6 and rows[0].duration_ms == 25


def test_stream_picks_up_new_files_once(spark, tmp_path):
    logs, store, mark = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "mark")
    write_lines(logs / "a", small_log("a"))
    live.ingest(spark, str(logs), store, mark)
    write_lines(logs / "b", small_log("b"))
    live.ingest(spark, str(logs), store, mark)
    assert spark.read.parquet(store).count() == 2 * len(small_log())
