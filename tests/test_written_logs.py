"""Logs derived from the driver tables, and the work of their readers."""

import gzip
import json

import pytest
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from eventlens.bench import logs, reg_stream, registry
from eventlens.bench import views as v
from eventlens.plans.stash import setting, shared_folder
from eventlens.sources import normalize, readers, sinks, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables_of_apps(spark, tmp_path_factory):
    """Small tables of eight applications, one of them with most of the line items."""
    d = str(tmp_path_factory.mktemp("sf"))
    items = v._read(spark, SF, "lineitem")
    items.withColumn("l_orderkey", F.expr("IF(l_linenumber < 5, l_orderkey div 8 * 8 + 3, l_orderkey)")).coalesce(2).write.parquet(f"{d}/lineitem.parquet")
    for name in ("orders", "events"):
        v._read(spark, SF, name).write.parquet(f"{d}/{name}.parquet")
    return d


def test_logs_are_written_in_compressed_files_of_bounded_size(spark, tmp_path, tables_of_apps, monkeypatch):
    monkeypatch.setattr(logs, "FILE_ROWS", 500)
    path = logs.write_events(spark, tables_of_apps, str(tmp_path / "logs"), arrays="app_id < 'app-4'")
    files = sorted((tmp_path / "logs").glob("**/part-*"))
    assert len(files) > 16 and all(f.name.endswith(".txt.gz") for f in files)
    seen = 0
    for f in files:
        with gzip.open(f, "rt") as text:
            is_array = "app_id=app-0" < str(f)[str(f).index("app_id="):] < "app_id=app-4"
            events = json.load(text) if is_array else [json.loads(x) for x in text]
        assert 0 < sum(e["Event"] == "SparkListenerTaskEnd" for e in events) <= 500 or "roll=others" in str(f)
        seen += len(events)
    assert seen == logs.event_lines(spark, tables_of_apps).count()
    assert {r.format for r in readers.detect_format(spark, path).collect()} == {"array", "ndjson"}


def test_a_text_is_parsed_once(spark):
    stored = spark.range(5).selectExpr("concat('{\"Event\": \"x', id, '\"}') AS value", "id AS app_id")
    plan = normalize.event_counts(readers.parse_lines(stored))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_gzip_files_enough_for_the_tasks_are_not_shuffled(spark, tmp_path):
    for k in range(3):
        with gzip.open(tmp_path / f"{k}.gz", "wt") as f:
            f.write('{"Event": "x"}\n')
    events = readers.scan_gzip(spark, str(tmp_path), 1)
    assert "Exchange" not in events._jdf.queryExecution().executedPlan().toString() and events.count() == 3


def test_stream_source_is_written_where_it_is_read(spark, tables_of_apps, monkeypatch):
    def refuse(*args):
        raise AssertionError("a fixed number of parts")

    monkeypatch.setattr(DataFrame, "repartition", refuse)
    assert shared_folder(spark)
    assert reg_stream._counted(spark, tables_of_apps).agg(F.sum("tasks")).first()[0] == v._read(spark, tables_of_apps, "lineitem").count()


def test_events_are_not_shuffled_for_their_application(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"Event": "SparkListenerApplicationStart" if k == 7 else "x", "App ID": "app-a", "Timestamp": k}) + "\n" for k in range(90_000)))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "8000"):  # less than the log, as with large logs
        scanned = readers.scan_ndjson(spark, str(tmp_path))
        stored, lazy = [tables.attach_app_ids(scanned, ids) for ids in (None, tables.log_ids(scanned))]
        plans = [e._jdf.queryExecution().executedPlan().toString() for e in (stored, lazy)]
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        assert "SortMergeJoin" in plans[1]  # ids of unknown size, as it was
        assert [[tuple(r) for r in e.groupBy("app_id").count().collect()] for e in (stored, lazy)] == [[("app-a", 90_000)]] * 2


def test_logs_are_in_order_before_they_are_text(spark, tables_of_apps):
    items = v._read(spark, tables_of_apps, "lineitem").withColumn("app_id", F.expr(v.APP_OF_ITEM))
    for where in ("false", "true"):
        lines = logs._array(logs._task_lines(logs._rolled(items, "tasks"), "app_id", "folder", "roll", "first", "last"), where)
        files = lines.select(F.col("folder").alias("eventlog_v2_app_id"), "roll", "value")
        order = files._jdf.queryExecution().optimizedPlan().outputOrdering().mkString(", ")
        assert order.startswith("eventlog_v2_app_id") and ", roll" in order
        assert not files.schema["eventlog_v2_app_id"].nullable and not files.schema["roll"].nullable


def test_only_the_fields_that_are_used_are_parsed(spark, tables_of_apps):
    lines = logs.stored(logs.noisy_lines(spark, tables_of_apps))
    some = readers.parse_lines(lines, fields=("Event",))
    assert some.columns == ["app_id", "raw", "Event", "_corrupt_record"]
    whole = readers.parse_lines(lines)
    for rows in (lambda e: normalize.event_counts(e), lambda e: e.groupBy("Event", (F.col("_corrupt_record").isNull()).alias("ok")).count()):
        assert sorted(map(tuple, rows(some).collect()), key=repr) == sorted(map(tuple, rows(whole).collect()), key=repr)
    for query in ("global_counts", "nested_get_default", "event_type_counts", "event_filter"):
        plan = registry.QUERIES[query](spark, tables_of_apps)._jdf.queryExecution().optimizedPlan().toString()
        assert "Spark Properties" not in plan and plan.count("from_json") == 1


def test_wide_events_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen = []
    key = sinks.OPEN_FILES[0]
    for name in ("json", "parquet"):
        monkeypatch.setattr(DataFrameWriter, name, lambda self, *a, f=getattr(DataFrameWriter, name), **b: (seen.append(spark.conf.get(key)), f(self, *a, **b))[1])
    events = spark.range(60).selectExpr("concat('app-', id % 40) AS app_id", "concat('e', id % 40) AS Event", "id AS Timestamp")
    before = spark.conf.get(key, None)
    sinks.write_events_json(events, str(tmp_path / "json"))
    sinks.write_events_parquet(events, str(tmp_path / "parquet"))
    assert seen == [sinks.OPEN_FILES[1]] * 2 and spark.conf.get(key, None) == before
    # also with more folders than open files
    assert spark.read.json(str(tmp_path / "json")).groupBy("app_id").count().count() == 40 and spark.read.parquet(str(tmp_path / "parquet")).count() == 60


def test_arrays_of_a_mixed_folder_are_parsed_once(spark, tmp_path, tables_of_apps):
    path = logs.write_events(spark, tables_of_apps, str(tmp_path / "mixed"), arrays="app_id < 'app-4'", only="app_id IS NOT NULL")
    events = readers.scan_events(spark, path)
    plan = tables.tasks(tables.attach_app_ids(events))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "MapInArrow" not in plan
    assert events.where("Event IS NOT NULL").count() == logs.event_lines(spark, tables_of_apps).where("app_id IS NOT NULL").count()
