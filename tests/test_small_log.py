"""A whole log through the whole diagnosis, against known figures."""

import numpy as np
import pytest
from conftest import LOST_AT, STAGES, TASKS, WORKERS, small_log, write_array, write_lines

from eventlens.operators import detectors, metrics, stages
from eventlens.plans.corpus import Corpus, Diagnosis
from eventlens.plans.report import SCORE, health_status


@pytest.fixture(scope="module")
def diagnosis(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    write_array(folder / "one.json", small_log())
    other = small_log("app-other")
    for e in other:
        if e["Event"] == "SparkListenerTaskEnd":
            e["Task Info"]["Finish Time"] += 90_000
    write_lines(folder / "two", other)
    return Diagnosis(Corpus.load(spark, str(folder)))


def one(df):
    rows = df.filter("app_id = 'app-small'").collect()
    assert len(rows) == 1
    return rows[0]


LENGTHS = np.array([t.length for t in TASKS])
RUN = LENGTHS - 20


def test_task_figures(diagnosis):
    m = one(diagnosis.metrics)
    assert (m.total_tasks, m.mean_task_duration, m.median_task_duration) == (len(TASKS), LENGTHS.mean(), np.median(LENGTHS))
    assert m.std_task_duration == pytest.approx(LENGTHS.std(ddof=1)) and m.task_skew_ratio == pytest.approx(LENGTHS.std(ddof=1) / LENGTHS.mean())
    assert [m.p25, m.p50, m.p75, m.p90, m.p95, m.p99] == pytest.approx(np.quantile(LENGTHS, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]))
    assert m.gc_overhead_ratio == pytest.approx(sum(t.gc for t in TASKS) / RUN.sum()) and m.gc_pressure_level == "LOW"
    written = [t.written for t in TASKS if t.written]
    assert (m.shuffle_write_bytes, m.tasks_with_shuffle_write) == (sum(written), len(written))
    assert (m.shuffle_write_time_ms, m.shuffle_records_written) == (sum(w // 10_000 for w in written), sum(w // 50 for w in written))
    assert m.shuffle_time_ratio == pytest.approx(m.shuffle_write_time_ms / RUN.sum())
    assert m.memory_bytes_spilled == sum(t.spilled for t in TASKS) and m.shuffle_read_bytes == sum(t.read for t in TASKS)


def test_cpu_units(diagnosis):
    cpu = sum(int(r * t.cpu) for r, t in zip(RUN.tolist(), TASKS))
    raw = one(metrics.metric_group(diagnosis.corpus.tasks, "cpu", cpu_unit="raw"))
    assert raw.cpu_efficiency == pytest.approx(cpu * 1e6 / RUN.sum())
    assert one(diagnosis.metrics).cpu_efficiency == pytest.approx(cpu / RUN.sum())


def test_stages(diagnosis):
    rows = {r.stage_id: r for r in diagnosis.stage_details.filter("app_id = 'app-small'").collect()}
    assert sorted(rows) == sorted(STAGES)
    for stage, r in rows.items():
        x = np.array([t.length for t in TASKS if t.stage == stage])
        assert (r.total_tasks, r.total_duration_ms) == (len(x), x.sum()) and r.task_skew == pytest.approx((x.max() - x.min()) / x.mean())
    assert rows[7].status == "SUCCESS" and rows[7].stage_attempt == 1
    assert [(i.type, i.severity) for i in rows[7].issues] == [("DATA_SKEW", "HIGH"), ("STRAGGLER_TASKS", "MEDIUM")]
    x = np.array([t.length for t in TASKS if t.stage == 7])
    assert rows[7].issues[0].description == f"Data skew detected: task duration variance {(x.max() - x.min()) / x.mean():.1%}"
    summary = one(stages.stage_summary(diagnosis.stage_details))
    assert summary.total_duration_formatted == f"{LENGTHS.sum() / 1000:.1f}s" and summary.stages_with_issues == sum(bool(r.issues) for r in rows.values()) == 3


def test_failures(diagnosis):
    f = one(diagnosis.failure_counts)
    assert (f.total_stage_failures, f.total_task_failures, f.total_executor_failures, f.total_oom_events, f.total_fetch_failures) == (0, 1, 1, 0, 1)


def test_executor_anomalies(diagnosis):
    found = {r.type: r for r in diagnosis.executor_anomalies().filter("app_id = 'app-small'").collect()}
    assert found["FREQUENT_HEARTBEAT_TIMEOUTS"]["count"] == 1 and found["FREQUENT_HEARTBEAT_TIMEOUTS"].severity == "HIGH"
    assert found["SHORT_LIVED_EXECUTORS"]["count"] == 1
    stats = {r.executor_id: r for r in diagnosis.executor_stats.filter("app_id = 'app-small'").collect()}
    assert stats["w-c"].lifetime_ms == LOST_AT - WORKERS["w-c"][0]


def test_confidence_without_correlation(diagnosis):
    m = diagnosis.metrics.selectExpr("* EXCEPT (coefficient_of_variation, stragglers_percentage)", "0D AS coefficient_of_variation", "0D AS stragglers_percentage")
    f = one(detectors.bottlenecks(m, "bn_data_skew"))
    assert f.severity == "CRITICAL" and f.confidence == pytest.approx(0.5 + 0.3 / (1 + np.exp(-2.5)))


def test_health_of_simple_findings(diagnosis):
    simple = diagnosis.metrics.filter("app_id = 'app-small'")
    rows = detectors.simple_bottlenecks(simple)
    assert {r.type for r in rows.collect()} == {"DATA_SKEW", "EXECUTOR_LOSS"}
    arr = rows.groupBy("app_id").agg({"severity": "collect_list"}).selectExpr(
        "app_id", "transform(`collect_list(severity)`, s -> named_struct('severity', s, 'confidence', CAST(NULL AS DOUBLE))) AS findings")
    r = one(arr.selectExpr("app_id", f"{SCORE} AS score").selectExpr("*", f"{health_status('score')} AS status"))
    assert (r.score, r.status) == (50, "POOR")


def test_applications_do_not_mix(spark, diagnosis, tmp_path):
    write_lines(tmp_path / "alone" / "one", small_log())
    alone = Diagnosis(Corpus.load(spark, str(tmp_path / "alone")))
    pick = lambda df: sorted(map(str, df.filter("app_id = 'app-small'").collect()))
    assert pick(alone.metrics) == pick(diagnosis.metrics)
    assert pick(alone.chains()) == pick(diagnosis.chains())


def test_reports_are_written(spark, diagnosis, tmp_path):
    diagnosis.write(str(tmp_path / "out"))
    docs = spark.read.text(str(tmp_path / "out" / "documents"))
    assert docs.count() == 2
    text = [r.value for r in spark.read.text(str(tmp_path / "out" / "report" / "app_id=app-small")).collect()]
    assert text[0] == "# Spark Event Log Analysis Report" and any("Key Performance" in t for t in text)
    assert diagnosis.stage_job_report().count() > 0
