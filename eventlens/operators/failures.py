"""Failure detection and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import (FAILURE_PATTERNS, classify_failure, format_bytes, is_executor_failure, lit, matches_failure, percent, ratio)

# Fixed texts: failure class -> hypothesis
HYPOTHESES = {
    "OOM": "Out of Memory due to insufficient executor memory or memory leak. Check executor memory configuration and GC logs.",
    "FetchFailed": "Shuffle fetch failure due to network issues or executor loss. Check network stability and shuffle service configuration.",
    "ExecutorLost": "Executor lost due to crash, OOM, or container preemption. Review executor logs and resource manager logs.",
    "NetworkIssue": "Network connectivity issues between executors. Check network configuration and bandwidth.",
    "DiskFull": "Insufficient disk space for shuffle/spill operations. Increase disk space or reduce data volume per executor.",
    "Timeout": "Operation timeout, possibly due to slow executors or network congestion. Review timeout configurations and system load.",
}


def _agg(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def hypothesis(kind: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {lit(t)}" for k, t in HYPOTHESES.items())
    return f"CASE {kind} {arms} ELSE concat('Failure of type ', {kind}, '. Review logs for details.') END"


def executor_failure_cause(kind: str, level: str) -> str:
    return (f"CASE WHEN {kind} = 'OOM' OR {level} IN ('CRITICAL', 'HIGH') THEN concat('Executor likely failed due to memory pressure (GC pressure: ', {level}, "
            f"'). Increase spark.executor.memory and spark.executor.memoryOverhead.') ELSE {hypothesis(kind)} END")


def oom_cause(gc: str = "gc_overhead_ratio", spill: str = "memory_bytes_spilled") -> str:
    return (f"concat(concat_ws('. ', IF({gc} > 0.3D, 'Excessive GC overhead indicating severe memory pressure', NULL), "
            f"IF({spill} > 1000000000, concat('Large memory spill (', {format_bytes(spill)}, ') indicating insufficient memory'), NULL), "
            f"IF({gc} > 0.3D OR {spill} > 1000000000, NULL, 'Insufficient executor memory for workload')), "
            "'. Recommendation: Increase spark.executor.memory significantly.')")


def fetch_failure_cause(share: str = "shuffle_ratio", total: str = "total_shuffle_bytes") -> str:
    return (f"CASE WHEN {share} > 0.5D THEN concat('Heavy shuffle operations (', {percent(share)}, ' of time, ', {format_bytes(total)}, "
            "' data) likely causing network congestion. Consider reducing shuffle volume or enabling external shuffle service.') "
            "ELSE 'Network instability or executor failure during shuffle. Check network configuration and executor stability.' END")


def classified(tasks: DataFrame) -> DataFrame:
    """Distinct task end texts with their class and how often they occur."""
    texts = _agg(tasks.filter("end_reason_json IS NOT NULL"), ["app_id", "end_reason_json"], {"occurrences": "count(1)"})
    return texts.selectExpr("app_id", "end_reason_json", f"{classify_failure('end_reason_json')} AS failure_type", "occurrences")


def stage_failures(stages: DataFrame, stage_metrics: DataFrame) -> DataFrame:
    """Failed stage attempts with the figures of the stage and a hypothesis."""
    failed = stages.filter("is_completed AND length(failure_reason) > 0").selectExpr(
        "app_id", "stage_id", "attempt AS stage_attempt", f"{classify_failure('failure_reason')} AS failure_type", "failure_reason",
        "coalesce(completion_ms, 0) AS timestamp_ms")
    slim = stage_metrics.select("app_id", "stage_id", "total_tasks", "total_duration_ms", "gc_ratio", "total_memory_spilled", "shuffle_ratio")
    return failed.join(slim, ["app_id", "stage_id"], "left").selectExpr("*", f"{hypothesis('failure_type')} AS root_cause_hypothesis")


def task_failures(tasks: DataFrame) -> DataFrame:
    return tasks.filter("end_reason IS NOT NULL AND end_reason <> 'Success'").selectExpr(
        "app_id", "task_id", "stage_id", "executor_id", f"{classify_failure('end_reason_json')} AS failure_type", "end_reason AS failure_reason",
        "end_reason_json AS task_end_reason", "coalesce(finish_ms, 0) AS timestamp_ms", "duration_ms", "run_ms AS executor_run_time",
        "gc_ms AS jvm_gc_time", "mem_spill_bytes AS memory_bytes_spilled", "sh_read_bytes AS shuffle_read_bytes")


def _failed_removals(executor_events: DataFrame) -> DataFrame:
    return executor_events.filter(f"kind = 'REMOVED' AND {is_executor_failure('reason')}")


def executor_failures(executor_events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Removals whose text speaks of a failure, with the suspected cause given the GC level of the application."""
    rows = _failed_removals(executor_events).selectExpr(
        "app_id", "executor_id", f"{classify_failure('reason')} AS failure_type", "reason AS removed_reason", "coalesce(ts_ms, 0) AS timestamp_ms")
    return rows.join(metrics.select("app_id", "gc_pressure_level"), "app_id", "left").selectExpr(
        "app_id", "executor_id", "failure_type", "removed_reason", "timestamp_ms",
        f"{executor_failure_cause('failure_type', 'coalesce(gc_pressure_level, ' + lit('LOW') + ')')} AS suspected_cause")


def oom_rows(tasks: DataFrame, executor_events: DataFrame) -> DataFrame:
    lost = executor_events.filter(f"kind = 'REMOVED' AND {matches_failure('reason', 'OOM')}").selectExpr(
        "app_id", "'Executor OOM' AS type", "CAST(NULL AS BIGINT) AS task_id", "CAST(NULL AS BIGINT) AS stage_id", "executor_id",
        "coalesce(ts_ms, 0) AS timestamp_ms", "reason AS removed_reason")
    died = tasks.filter(matches_failure("end_reason_json", "OOM")).selectExpr(
        "app_id", "'Task OOM' AS type", "task_id", "stage_id", "executor_id", "coalesce(finish_ms, 0) AS timestamp_ms", "CAST(NULL AS STRING) AS removed_reason")
    return died.unionByName(lost)


def oom_events(tasks: DataFrame, executor_events: DataFrame, metrics: DataFrame) -> DataFrame:
    level = metrics.selectExpr("app_id", "gc_pressure_level AS gc_pressure_at_time", f"{oom_cause()} AS likely_cause")
    return oom_rows(tasks, executor_events).join(level, "app_id", "left")


def fetch_failures(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    cause = metrics.selectExpr("app_id", "shuffle_ratio", "total_shuffle_bytes", f"{fetch_failure_cause()} AS likely_cause")
    rows = tasks.filter("contains(end_reason, 'FetchFailed')").selectExpr(
        "app_id", "task_id", "stage_id", "executor_id", "coalesce(finish_ms, 0) AS timestamp_ms", "end_reason_json AS failure_reason")
    return rows.join(cause, "app_id", "left")


def failures_by_type(tasks: DataFrame) -> DataFrame:
    """Failed tasks per application and stage, one column per failure class."""
    failed = tasks.filter("end_reason IS NOT NULL AND end_reason <> 'Success'").selectExpr(
        "app_id", "stage_id", f"{classify_failure('end_reason_json')} AS failure_type")
    kinds = [k for k, _ in FAILURE_PATTERNS] + ["UNKNOWN"]
    out = failed.groupBy("app_id", "stage_id").pivot("failure_type", kinds).count()
    return out.selectExpr("app_id", "stage_id", *[f"coalesce({k}, 0) AS {k.lower()}" for k in kinds])


def failure_hypotheses(tasks: DataFrame) -> DataFrame:
    """Failure classes of an application with their hypothesis."""
    failed = tasks.filter("end_reason IS NOT NULL AND end_reason <> 'Success'").selectExpr("app_id", f"{classify_failure('end_reason_json')} AS failure_type")
    return _agg(failed, ["app_id", "failure_type"], {"failures": "count(1)"}).selectExpr("*", f"{hypothesis('failure_type')} AS hypothesis")


def failure_counts(tasks: DataFrame, stages: DataFrame, executor_events: DataFrame, task_parts: DataFrame | None = None) -> DataFrame:
    """The five failure counts and the attempts they came from, per application; every source is reduced before the union.

    With ``task_parts`` (see ``parts``) the tasks are not read.
    """
    if task_parts is not None:
        t = _agg(task_parts, ["app_id"], {"total_task_failures": "sum(task_failures)", "task_oom": "sum(task_oom)", "total_fetch_failures": "sum(fetch_failures)", "attempts": "sum(n)"})
    else:
        t = _agg(tasks, ["app_id"], {
            "total_task_failures": "count_if(end_reason IS NOT NULL AND end_reason <> 'Success')", "task_oom": f"count_if({matches_failure('end_reason_json', 'OOM')})",
            "total_fetch_failures": "count_if(contains(end_reason, 'FetchFailed'))", "attempts": "count(1)"})
    s = _agg(stages, ["app_id"], {"total_stage_failures": "count_if(is_completed AND length(failure_reason) > 0)", "attempts": "count(1)"})
    e = _agg(executor_events, ["app_id"], {
        "total_executor_failures": f"count_if(kind = 'REMOVED' AND {is_executor_failure('reason')})",
        "executor_oom": f"count_if(kind = 'REMOVED' AND {matches_failure('reason', 'OOM')})", "attempts": "count_if(kind = 'ADDED')"})
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t, s, e])
    names = ("total_stage_failures", "total_task_failures", "total_executor_failures", "task_oom", "executor_oom", "total_fetch_failures", "attempts")
    out = _agg(rows, ["app_id"], {n: f"coalesce(sum({n}), 0)" for n in names})
    return out.selectExpr("app_id", "total_stage_failures", "total_task_failures", "total_executor_failures", "task_oom + executor_oom AS total_oom_events",
                          "total_fetch_failures", "attempts")


def failure_summary(counts: DataFrame) -> DataFrame:
    total = "total_stage_failures + total_task_failures + total_executor_failures"
    return counts.selectExpr(
        "app_id", "total_stage_failures", "total_task_failures", "total_executor_failures", "total_oom_events", "total_fetch_failures",
        "total_oom_events > 0 OR total_stage_failures > 0 AS has_critical_failures", f"CAST({total} AS DOUBLE) AS failure_count",
        f"{ratio(total, 'attempts')} AS failure_rate")
