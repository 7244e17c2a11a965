"""Application-level metrics: one row per application, from sums with map-side combine.

All operators take the canonical ``tasks`` table and return one row per ``app_id``
unless stated.  Sums, minima and maxima combine before the shuffle, so an
application that holds a third of all tasks still sends one row per map task.
Quantiles use ``grouped_quantiles``, which never gathers a whole application in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.stats import grouped_quantiles, guarded_corr, merged_sketches, rank_error, rank_sketches, sketch_quantiles, value_counts
from eventlens.functions.text import ladder, ratio
from eventlens.operators import parts

PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}

# Bounds of the four GC pressure levels
GC_LEVELS = [(0.4, "CRITICAL"), (0.2, "HIGH"), (0.1, "MEDIUM")]

# Only tasks with a positive duration count in duration statistics.
VALID = "CASE WHEN duration_ms > 0 THEN duration_ms END"


def _sums(**names: str) -> dict[str, str]:
    return {out: f"coalesce(sum({src}), 0)" for out, src in names.items()}


def _positive(**names: str) -> dict[str, str]:
    return {out: f"count_if({src} > 0)" for out, src in names.items()}


AGGREGATES: dict[str, dict[str, str]] = {
    "task": {"total_tasks": f"count({VALID})", "mean_task_duration": f"coalesce(avg({VALID}), 0D)",
             "std_task_duration": f"coalesce(stddev_samp({VALID}), 0D)",
             "min_task_duration": f"min({VALID})", "max_task_duration": f"max({VALID})"},
    "cpu": {"cpu_time": "coalesce(sum(CAST(cpu_ns AS DOUBLE)), 0D)"}
           | _sums(total_run_time_ms="run_ms", total_deserialize_time_ms="deser_ms"),
    "heap": {"avg_heap": "CAST(coalesce(avg(heap_bytes), 0) AS BIGINT)", "max_heap": "max(heap_bytes)",
             "avg_offheap": "CAST(coalesce(avg(offheap_bytes), 0) AS BIGINT)", "max_offheap": "max(offheap_bytes)"}
            | _sums(total_heap="heap_bytes", total_offheap="offheap_bytes"),
    "gc": _sums(total_gc_time_ms="gc_ms", minor_gc_time_ms="minor_gc_ms", major_gc_time_ms="major_gc_ms", total_run_time_ms="run_ms"),
    "spill": _sums(memory_bytes_spilled="mem_spill_bytes", disk_bytes_spilled="disk_spill_bytes", input_bytes="in_bytes")
             | _positive(tasks_with_spill="mem_spill_bytes"),
    "shuffle": _sums(shuffle_read_bytes="sh_read_bytes", shuffle_write_bytes="sh_write_bytes", shuffle_time_ms="fetch_wait_ms",
                     total_run_time_ms="run_ms", shuffle_write_time_ms="sh_write_time", shuffle_records_written="sh_write_records")
               | _positive(tasks_with_shuffle_read="sh_read_bytes", tasks_with_shuffle_write="sh_write_bytes"),
    "io": _sums(input_bytes="in_bytes", output_bytes="out_bytes", input_records="in_records", output_records="out_records")
          | _positive(tasks_with_input="in_bytes", tasks_with_output="out_bytes"),
    "corr": {"gc_vs_duration": guarded_corr("gc_ms", "duration_ms"), "spill_vs_gc": guarded_corr("mem_spill_bytes", "gc_ms"),
             "shuffle_vs_duration": guarded_corr("fetch_wait_ms", "duration_ms")},
}

CPU_MS = {"ns": "cpu_time / 1e6D", "raw": "cpu_time"}


def _derived(cpu_unit: str) -> dict[str, dict[str, str]]:
    """Columns computed from the aggregates of the same group."""
    cpu = CPU_MS[cpu_unit]
    eff = ratio(cpu, "total_run_time_ms")
    wait = f"CASE WHEN total_run_time_ms > 0 THEN 1D - {eff} ELSE 0D END"
    gc = ratio("total_gc_time_ms", "total_run_time_ms")
    shuffle = ratio("shuffle_time_ms", "total_run_time_ms")
    written = ratio("shuffle_write_time_ms", "total_run_time_ms")
    cv = ratio("std_task_duration", "mean_task_duration")
    return {
        "task": {"duration_range": "max_task_duration - min_task_duration", "task_skew_ratio": cv, "coefficient_of_variation": cv},
        "cpu": {"cpu_efficiency": eff, "cpu_utilization_percentage": f"{eff} * 100D", "cpu_wait_ratio": wait,
                "cpu_wait_percentage": f"({wait}) * 100D", "total_cpu_time_ms": f"CAST({cpu} AS BIGINT)",
                "deserialize_overhead_percentage": ratio("total_deserialize_time_ms", "total_run_time_ms") + " * 100D"},
        "gc": {"gc_overhead_ratio": gc, "gc_overhead_percentage": f"{gc} * 100D", "gc_pressure_level": ladder(gc, GC_LEVELS, "LOW")},
        "spill": {"total_spilled": "memory_bytes_spilled + disk_bytes_spilled",
                  "spill_ratio": ratio("memory_bytes_spilled", "input_bytes")},
        "shuffle": {"total_shuffle_bytes": "shuffle_read_bytes + shuffle_write_bytes", "shuffle_ratio": shuffle,
                    "shuffle_time_percentage": f"{shuffle} * 100D", "shuffle_time_ratio": written,
                    "shuffle_write_percentage": f"{written} * 100D", "shuffle_efficiency": f"1D - least({shuffle}, 1D)"},
    }


def _agg(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def metric_group(tasks: DataFrame, *groups: str, keys: tuple[str, ...] = ("app_id",), cpu_unit: str = "ns") -> DataFrame:
    """One aggregation for the named metric groups; other task columns are not read."""
    aggs = {n: e for g in groups for n, e in AGGREGATES[g].items()}
    return _with_derived(_agg(tasks, list(keys), aggs), groups, keys, cpu_unit)


def _with_derived(sums: DataFrame, groups: tuple[str, ...], keys: tuple[str, ...], cpu_unit: str) -> DataFrame:
    more = {n: e for g in groups for n, e in _derived(cpu_unit).get(g, {}).items()}
    keep = list(dict.fromkeys(n for g in groups for n in AGGREGATES[g] if n != "cpu_time"))
    return sums.selectExpr(*keys, *keep, *[f"{e} AS {n}" for n, e in more.items()])


def metrics_of_parts(task_parts: DataFrame, *groups: str, keys: tuple[str, ...] = ("app_id",), cpu_unit: str = "ns") -> DataFrame:
    """``metric_group`` from the parts of the tasks (see ``parts``), at any grain."""
    aggs = {n: e for g in groups for n, e in parts.AGGREGATES[g].items()}
    whole = parts.combined(task_parts, list(keys))
    return _with_derived(whole.selectExpr(*keys, *[f"{e} AS {n}" for n, e in aggs.items()]), groups, keys, cpu_unit)


def duration_counts(tasks: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    return value_counts(tasks.filter("duration_ms > 0"), list(keys), "duration_ms")


def duration_quantiles(tasks: DataFrame, keys: tuple[str, ...] = ("app_id",), probs: dict[str, float] | None = None) -> DataFrame:
    return grouped_quantiles(duration_counts(tasks, keys), list(keys), probs or PERCENTILES)


def approximate_quantiles(tasks: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Sketch-based variant of ``task_percentiles`` in a single aggregation."""
    probs = ", ".join(str(p) for p in PERCENTILES.values())
    out = _agg(tasks, ["app_id"], {"q": f"percentile_approx({VALID}, array({probs}), {accuracy})"})
    return out.selectExpr("app_id", *[f"CAST(q[{i}] AS DOUBLE) AS {n}" for i, n in enumerate(PERCENTILES)])


def duration_sketches(tasks: DataFrame, keys: tuple[str, ...] = ("app_id", "stage_id")) -> DataFrame:
    """A mergeable sketch of task durations for each stage, to be stored beside a log and put together later."""
    return rank_sketches(tasks.filter("duration_ms > 0"), list(keys), "duration_ms")


def sketch_rank_errors(tasks: DataFrame, sketches: DataFrame) -> DataFrame:
    """(app_id, name, total, rank_error, within_bound): how far each quantile of the merged sketches is from its true rank, as a share of the tasks."""
    found = sketch_quantiles(merged_sketches(sketches, ["app_id"]), ["app_id"], PERCENTILES)
    long = found.selectExpr("app_id", "total", f"stack({len(PERCENTILES)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {p}D, {n}' for n, p in PERCENTILES.items())}) AS (name, p, q)")
    below = tasks.filter("duration_ms > 0").join(long, "app_id").groupBy("app_id", "name", "p", "total").agg(
        F.expr("count_if(duration_ms < q) AS less"), F.expr("count_if(duration_ms <= q) AS upto"))
    off = "greatest(less / CAST(total AS DOUBLE) - p, p - upto / CAST(total AS DOUBLE), 0D)"  # any rank of equal values will do
    return below.selectExpr("app_id", "name", "total", f"{off} AS rank_error", f"{off} <= {rank_error()}D AS within_bound")


def task_stats(tasks: DataFrame) -> DataFrame:
    """Count, mean, median, sample deviation, minimum, maximum and range of task durations."""
    base = _agg(tasks, ["app_id"], AGGREGATES["task"]).selectExpr("*", "max_task_duration - min_task_duration AS duration_range")
    return base.join(duration_quantiles(tasks, probs={"median_task_duration": 0.5}), "app_id", "left")


def task_percentiles(tasks: DataFrame) -> DataFrame:
    return duration_quantiles(tasks)


def task_skew_ratio(tasks: DataFrame) -> DataFrame:
    """Coefficient of variation of task durations; 0 for a single task."""
    return metric_group(tasks, "task").select("app_id", "task_skew_ratio", "coefficient_of_variation")


def _with_stragglers(counts: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles plus the tasks above p75 + 1.5 IQR, counted on the (duration, count) table instead of the tasks.

    ``counts`` is a stored table, so the tasks are read once however often it is used.
    """
    fences = grouped_quantiles(counts, ["app_id"], probs).selectExpr("*", "p75 + 1.5D * (p75 - p25) AS outlier_threshold")
    out = _agg(counts.join(fences, "app_id"), ["app_id"], {q: f"max({q})" for q in (*probs, "outlier_threshold")} | {
        "total": "sum(n)", "stragglers_count": "coalesce(sum(n) FILTER (WHERE value > outlier_threshold), 0)"})
    return out.selectExpr("app_id", *probs, "outlier_threshold", "stragglers_count",
                          ratio("stragglers_count", "total") + " * 100D AS stragglers_percentage")


def stragglers(tasks: DataFrame) -> DataFrame:
    """Tasks beyond p75 + 1.5 IQR: threshold, count and share."""
    return _with_stragglers(duration_counts(tasks), {"p25": 0.25, "p75": 0.75}).drop("p25", "p75")


def executor_task_counts(tasks: DataFrame) -> DataFrame:
    """(app_id, executor_id, tasks)."""
    return _agg(tasks.filter("executor_id IS NOT NULL"), ["app_id", "executor_id"], {"tasks": "count(1)"})


def executor_imbalance(tasks: DataFrame) -> DataFrame:
    """Population deviation over mean of the task counts per executor, and their spread."""
    return _imbalance(executor_task_counts(tasks))


def _imbalance(counts: DataFrame) -> DataFrame:
    out = _agg(counts, ["app_id"], {
        "total_executors": "count(1)", "sd": "stddev_pop(tasks)", "min_tasks_per_executor": "min(tasks)",
        "max_tasks_per_executor": "max(tasks)", "mean_tasks_per_executor": "avg(tasks)"})
    return out.selectExpr(
        "app_id", "total_executors", "min_tasks_per_executor", "max_tasks_per_executor", "mean_tasks_per_executor",
        ratio("sd", "mean_tasks_per_executor") + " AS executor_imbalance_ratio",
        ratio("max_tasks_per_executor - min_tasks_per_executor", "mean_tasks_per_executor") + " * 100D AS load_imbalance_percentage")


def executor_churn(executor_events: DataFrame) -> DataFrame:
    """Added and removed executors per application."""
    return _agg(executor_events, ["app_id"], {
        "executors_added": "count_if(kind = 'ADDED')", "executors_removed": "count_if(kind = 'REMOVED')",
        "has_executor_loss": "count_if(kind = 'REMOVED') > 0"})


def removal_reasons(executor_events: DataFrame) -> DataFrame:
    """(app_id, reason, removals): the reason list as rows, so that it may be of any length."""
    rows = executor_events.filter("kind = 'REMOVED'").selectExpr("app_id", "coalesce(reason, '') AS reason")
    return _agg(rows, ["app_id", "reason"], {"removals": "count(1)"})


def global_counts(raw_events: DataFrame) -> DataFrame:
    """Event counts per application from (app_id, event)."""
    events = {"total_jobs": "JobEnd", "total_stages": "StageCompleted", "total_tasks": "TaskEnd",
              "executors_added": "ExecutorAdded", "executors_removed": "ExecutorRemoved"}
    return _agg(raw_events, ["app_id"], {n: f"count_if(event = 'SparkListener{e}')" for n, e in events.items()} | {"total_events": "count(1)"})


def app_duration(applications: DataFrame) -> DataFrame:
    return applications.selectExpr("app_id", "app_name", "start_ms", "end_ms", "end_ms - start_ms AS application_duration_ms")


def stage_failure_rate(stages: DataFrame) -> DataFrame:
    """Failed attempts, retried stages and failed share of all attempts."""
    per_stage = _agg(stages, ["app_id", "stage_id"], {
        "attempts": "count(1)", "failed": "count(failure_reason)", "retried": "CAST(max(attempt) > 0 AS BIGINT)"})
    out = _agg(per_stage, ["app_id"], {"total_stages": "count(1)", "stage_attempts": "sum(attempts)", "failed_stages": "sum(failed)",
                                       "retried_stages": "sum(retried)"})
    return out.selectExpr("*", ratio("failed_stages", "stage_attempts") + " AS failure_rate")


def correlations(tasks: DataFrame) -> DataFrame:
    return metric_group(tasks, "corr")


def dynamic_thresholds(tasks: DataFrame) -> DataFrame:
    """(app_id, metric, outlier_fence, p95) of duration, GC share of the run time and spilled bytes per task, unrounded.

    A task without run time has GC share 0. Negative values, which only damaged logs have, take part as they are.
    """
    rows = tasks.selectExpr("app_id", """explode(map('task_duration_ms', CAST(duration_ms AS DOUBLE), 'task_gc_ratio', coalesce(try_divide(CAST(gc_ms AS DOUBLE), run_ms), 0D),
        'task_spill_bytes', CAST(mem_spill_bytes AS DOUBLE))) AS (metric, v)""")
    q = grouped_quantiles(value_counts(rows, ["app_id", "metric"], "v"), ["app_id", "metric"], {"p25": 0.25, "p75": 0.75, "p95": 0.95})
    return q.selectExpr("app_id", "metric", "p75 + 1.5D * (p75 - p25) AS outlier_fence", "p95")


TASK_GROUPS = ("task", "cpu", "gc", "heap", "spill", "shuffle", "io", "corr")
ALL_GROUPS = (*TASK_GROUPS, "quantiles", "executors", "stages", "churn", "jobs")


def app_metrics(corpus, *include: str, cpu_unit: str = "ns") -> DataFrame:
    """Application metrics in one wide row per application.

    ``include`` names the wanted groups (default: all), so a detector that needs GC and spill
    figures costs a single aggregation.  Every piece is one row per application, so they are stacked and
    merged by one small aggregation instead of a chain of joins.  Applications without tasks keep zeros.
    """
    include = include or ALL_GROUPS
    rows = []
    groups = [g for g in TASK_GROUPS if g in include]
    stored = bool(groups) and "executors" in include  # both follow from the stored parts, with one pass over the tasks
    if groups:
        rows.append(metrics_of_parts(corpus.task_parts, *groups, cpu_unit=cpu_unit) if stored else metric_group(corpus.tasks, *groups, cpu_unit=cpu_unit))
    if "quantiles" in include:
        rows.append(_with_stragglers(corpus.duration_counts, PERCENTILES).selectExpr("*", "p50 AS median_task_duration"))
    if "executors" in include:
        ran = _agg(corpus.task_parts.filter("executor_id IS NOT NULL"), ["app_id", "executor_id"], {"tasks": "sum(n)"}) if stored else executor_task_counts(corpus.tasks)
        rows.append(_imbalance(ran))
    if "stages" in include:
        rows.append(stage_failure_rate(corpus.stages))
    if "churn" in include:
        rows.append(executor_churn(corpus.executor_events))
    if "jobs" in include:
        rows.append(_agg(corpus.jobs, ["app_id"], {"total_jobs": "count(completion_ms)"}))
    rows.append(corpus.applications.selectExpr("app_id", "app_name", "duration_ms AS application_duration_ms"))
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    filled = {}
    for f in wide.schema:
        default = {"string": "'LOW'", "boolean": "false"}.get(f.dataType.typeName(), "0")
        filled[f.name] = f"max({f.name})" if f.name == "app_name" else f"coalesce(max({f.name}), {default})"
    del filled["app_id"]
    return _agg(wide, ["app_id"], filled)


LONG_METRICS = (
    "total_tasks", "mean_task_duration", "median_task_duration", "std_task_duration", "min_task_duration", "max_task_duration",
    "task_skew_ratio", "p25", "p50", "p75", "p90", "p95", "p99", "stragglers_count", "stragglers_percentage",
    "outlier_threshold", "cpu_efficiency", "cpu_wait_ratio", "total_run_time_ms", "total_cpu_time_ms",
    "deserialize_overhead_percentage", "gc_overhead_ratio", "total_gc_time_ms", "memory_bytes_spilled", "disk_bytes_spilled",
    "total_spilled", "tasks_with_spill", "spill_ratio", "shuffle_read_bytes", "shuffle_write_bytes", "total_shuffle_bytes",
    "shuffle_ratio", "shuffle_time_ratio", "shuffle_efficiency", "input_bytes", "output_bytes", "input_records",
    "output_records", "total_executors", "executor_imbalance_ratio", "load_imbalance_percentage", "failed_stages",
    "retried_stages", "failure_rate", "total_jobs", "total_stages", "gc_vs_duration", "spill_vs_gc", "shuffle_vs_duration",
)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(app_id, metric, value) for rules and reports."""
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in LONG_METRICS)
    return metrics.selectExpr("app_id", f"stack({len(LONG_METRICS)}, {pairs}) AS (metric, value)")


ROLLUP_SUMS = ("duration_ms", "run_ms", "gc_ms", "fetch_wait_ms", "mem_spill_bytes", "sh_read_bytes", "sh_write_bytes", "in_bytes", "out_bytes")


def rollup_metrics(tasks: DataFrame) -> DataFrame:
    """The same sums per application, per stage and per executor.

    Tasks are first reduced to (application, stage, executor), and only that small table goes through
    the grouping sets, so the task rows are not replicated once per grain.
    """
    fine = _agg(tasks, ["app_id", "stage_id", "executor_id"], {"n": "count(1)"} | {m: f"sum({m})" for m in ROLLUP_SUMS})
    sets = [[F.col(k) for k in keys] for keys in (("app_id",), ("app_id", "stage_id"), ("app_id", "executor_id"))]
    out = fine.groupingSets(sets, "app_id", "stage_id", "executor_id").agg(
        F.expr("grouping_id() AS gid"), F.expr("sum(n) AS tasks"), *[F.expr(f"sum({m}) AS {m}") for m in ROLLUP_SUMS])
    return out.selectExpr("CASE gid WHEN 3 THEN 'app' WHEN 1 THEN 'stage' ELSE 'executor' END AS grain", "app_id", "stage_id",
                          "executor_id", "tasks", *ROLLUP_SUMS)
