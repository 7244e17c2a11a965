"""Mergeable task parts against direct aggregation, and the number of passes over the tasks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from eventlens.bench.views import BenchCorpus
from eventlens.operators import metrics, parts, stages
from eventlens.plans.corpus import Diagnosis

SF = "/root/testdata/sf0.001"


def same(a, b, keys):
    assert sorted(a.columns) == sorted(b.columns)
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (a, b))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            found = got[key][name]
            assert found == (pytest.approx(value, rel=1e-6, abs=1e-9) if isinstance(value, float) else value), (key, name)


@pytest.fixture(scope="module")
def tasks(spark):
    return BenchCorpus(spark, SF).tasks


def odd(t):
    """Tasks with a constant column, missing executors and figures far from zero."""
    return t.withColumns({"executor_id": F.expr("IF(task_id % 11 = 0, NULL, executor_id)"), "fetch_wait_ms": F.expr("IF(app_id = 'app-1', 7L, fetch_wait_ms)"),
                          "mem_spill_bytes": F.expr("IF(app_id = 'app-2', 1000000000 + task_id % 7, mem_spill_bytes)"),
                          "duration_ms": F.expr("IF(app_id = 'app-3', 0L, duration_ms)")})


def test_parts_equal_direct_aggregation(spark, tasks):
    t = odd(tasks)
    whole = parts.task_parts(t)
    for keys in (("app_id",), ("app_id", "stage_id")):
        got, want = (f(x, "task", "cpu", "gc", "spill", "shuffle", "io", "corr", keys=keys) for f, x in ((metrics.metrics_of_parts, whole), (metrics.metric_group, t)))
        same(got, want, keys)
    same(stages.stage_metrics_of_parts(whole), stages.stage_metrics(t), ("app_id", "stage_id"))


def test_adding_a_log_equals_a_full_run(spark, tasks):
    t = odd(tasks)
    later = parts.added(parts.added(parts.task_parts(t.where("task_id % 3 = 0")), parts.task_parts(t.where("task_id % 3 = 1"))), parts.task_parts(t.where("task_id % 3 = 2")))
    same(metrics.metrics_of_parts(later, "task", "corr"), metrics.metric_group(t, "task", "corr"), ("app_id",))


def test_a_diagnosis_passes_over_the_tasks_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return True

    class Counted(BenchCorpus):
        pass

    corpus = Counted(spark, SF)
    base = corpus.tasks
    corpus.__dict__["tasks"] = base.where(F.udf(count, BooleanType())("task_id"))
    d = Diagnosis(corpus)
    assert d.findings().count() and d.documents().count() and d.chains().count() and d.executor_anomalies().count() >= 0 and d.stage_job_report().count()
    assert seen.value == 2 * base.count()
