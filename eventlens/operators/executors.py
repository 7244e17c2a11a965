"""Executor life cycle, anomalies and memory over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import format_duration, ratio

# Fixed value: an executor that lived less than this is short-lived
SHORT_LIFE_MS = 60000


def _agg(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def executor_stats(executor_events: DataFrame, tasks: DataFrame, task_parts: DataFrame | None = None) -> DataFrame:
    """One row per executor known from any of: added, removed, ran a task.

    The three kinds are unioned and aggregated once, which is the full outer join without
    a join; tasks are reduced to one row per executor before the union. With ``task_parts`` (see ``parts``) they are not read.
    """
    if task_parts is None:
        ran = _agg(tasks.filter("executor_id IS NOT NULL"), ["app_id", "executor_id"], {"n": "count(1)", "busy": "sum(duration_ms)"})
    else:
        ran = _agg(task_parts.filter("executor_id IS NOT NULL"), ["app_id", "executor_id"], {"n": "sum(n)", "busy": "sum(sum_duration_ms)"})
    rows = executor_events.selectExpr("app_id", "executor_id", "kind", "ts_ms", "host", "cores", "coalesce(reason, '') AS reason", "0L AS n", "0L AS busy").unionByName(
        ran.selectExpr("app_id", "executor_id", "'TASK' AS kind", "CAST(NULL AS BIGINT) AS ts_ms", "CAST(NULL AS STRING) AS host",
                       "CAST(NULL AS BIGINT) AS cores", "CAST(NULL AS STRING) AS reason", "n", "busy"))
    out = _agg(rows, ["app_id", "executor_id"], {
        "added_ms": "max(ts_ms) FILTER (WHERE kind = 'ADDED')", "removed_ms": "max(ts_ms) FILTER (WHERE kind = 'REMOVED')",
        "removal_reason": "max_by(reason, ts_ms) FILTER (WHERE kind = 'REMOVED')", "hosts": "array_sort(collect_set(host))",
        "cores": "max_by(cores, ts_ms) FILTER (WHERE kind = 'ADDED')", "times_added": "count_if(kind = 'ADDED')",
        "tasks_executed": "sum(n)", "total_duration_ms": "sum(busy)"})
    return out.selectExpr("*", "removed_ms - added_ms AS lifetime_ms")


def executor_timeline(executor_events: DataFrame) -> DataFrame:
    """Added and removed events in time order; a removal carries the lifetime (0 when the start is unknown)."""
    added = _agg(executor_events.filter("kind = 'ADDED'"), ["app_id", "executor_id"], {"added_ms": "max(ts_ms)"})
    return executor_events.join(added, ["app_id", "executor_id"], "left").selectExpr(
        "app_id", "ts_ms", "kind AS event", "executor_id", "host", "cores", "reason",
        "CASE WHEN kind = 'REMOVED' THEN coalesce(ts_ms - added_ms, 0) END AS lifetime_ms")


def executor_lifetime(stats: DataFrame) -> DataFrame:
    return stats.filter("lifetime_ms IS NOT NULL").select("app_id", "executor_id", "added_ms", "removed_ms", "lifetime_ms")


def heartbeat_timeouts(executor_events: DataFrame) -> DataFrame:
    """Applications that lost executors to heartbeat timeouts."""
    lost = executor_events.filter("kind = 'REMOVED' AND contains(lower(reason), 'heartbeat')")
    return _agg(lost, ["app_id"], {"count": "count(1)"}).selectExpr(
        "app_id", "'FREQUENT_HEARTBEAT_TIMEOUTS' AS type", "IF(count > 2, 'CRITICAL', 'HIGH') AS severity", "count",
        "concat(count, ' executor(s) lost due to heartbeat timeout') AS description")


def short_lived_executors(stats: DataFrame) -> DataFrame:
    """Removed executors that lived under a minute; an unknown lifetime counts as 0."""
    return stats.filter(f"removed_ms IS NOT NULL AND coalesce(lifetime_ms, 0) < {SHORT_LIFE_MS}").selectExpr(
        "app_id", "executor_id", "coalesce(lifetime_ms, 0) AS lifetime_ms", "removal_reason AS reason")


def idle_executors(stats: DataFrame) -> DataFrame:
    return stats.filter("removed_ms IS NOT NULL AND tasks_executed = 0").select("app_id", "executor_id", "removed_ms")


# Fixed texts of the executor anomalies: type -> (probable cause, recommendation)
ANOMALY_TEXTS = {
    "FREQUENT_HEARTBEAT_TIMEOUTS": ("Network issues, long GC pauses, or overloaded executors",
                                    "Increase spark.executor.heartbeatInterval and spark.network.timeout"),
    "SHORT_LIVED_EXECUTORS": ("Executor crashes, OOM, or configuration issues",
                              "Check executor logs for crashes and increase memory if needed"),
    "IDLE_EXECUTORS": ("Executor added but not utilized, or removed before task assignment",
                       "Check dynamic allocation settings and task scheduling"),
}


def executor_anomalies(stats: DataFrame) -> DataFrame:
    """Heartbeat, short-lived and idle findings, counted in one pass over the executor table."""
    per_app = _agg(stats.filter("removed_ms IS NOT NULL"), ["app_id"], {
        "heartbeat": "count_if(contains(lower(removal_reason), 'heartbeat'))",
        "short": f"count_if(coalesce(lifetime_ms, 0) < {SHORT_LIFE_MS})", "idle": "count_if(tasks_executed = 0)"})
    kinds = per_app.selectExpr("app_id", """explode(array(
        named_struct('type', 'FREQUENT_HEARTBEAT_TIMEOUTS', 'severity', IF(heartbeat > 2, 'CRITICAL', 'HIGH'), 'count', heartbeat,
                     'description', concat(heartbeat, ' executor(s) lost due to heartbeat timeout')),
        named_struct('type', 'SHORT_LIVED_EXECUTORS', 'severity', 'HIGH', 'count', short,
                     'description', concat(short, ' executor(s) lived less than 1 minute')),
        named_struct('type', 'IDLE_EXECUTORS', 'severity', 'MEDIUM', 'count', idle,
                     'description', concat(idle, ' executor(s) executed no tasks')))) AS k""").selectExpr("app_id", "k.*").filter("count > 0")
    cause = " ".join(f"WHEN '{t}' THEN '{c}'" for t, (c, _) in ANOMALY_TEXTS.items())
    advice = " ".join(f"WHEN '{t}' THEN '{r}'" for t, (_, r) in ANOMALY_TEXTS.items())
    return kinds.selectExpr("*", f"CASE type {cause} END AS probable_cause", f"CASE type {advice} END AS recommendation")


def executor_summary(stats: DataFrame) -> DataFrame:
    """Totals per application, one row per removal reason (reason NULL when nothing was removed)."""
    totals = _agg(stats, ["app_id"], {
        "total_executors": "count(1)", "executors_added": "sum(times_added)", "executors_removed": "count(removed_ms)",
        "avg_life": "coalesce(avg(lifetime_ms) FILTER (WHERE lifetime_ms <> 0), 0D)", "total_tasks_executed": "sum(tasks_executed)"})
    reasons = _agg(stats.filter("length(removal_reason) > 0"), ["app_id", "removal_reason"], {"reason_count": "count(1)"})
    return totals.join(reasons, "app_id", "left").selectExpr(
        "app_id", "total_executors", "executors_added", "executors_removed", "CAST(avg_life AS BIGINT) AS avg_lifetime_ms",
        f"{format_duration('avg_life')} AS avg_lifetime_formatted", "total_tasks_executed",
        "IF(executors_removed = 0, 'STABLE', 'UNSTABLE') AS executor_stability", "removal_reason", "reason_count")


def block_manager_capacity(block_managers: DataFrame) -> DataFrame:
    """Largest on-heap and off-heap memory per executor and when its block manager came and went."""
    return _agg(block_managers, ["app_id", "executor_id"], {
        "max_onheap": "max(max_onheap)", "max_offheap": "max(max_offheap)", "added_ms": "min(added_ms)", "removed_ms": "max(removed_ms)"})


def executor_memory_timeline(tasks: DataFrame, block_managers: DataFrame, every: str = "1 minute") -> DataFrame:
    """Highest heap use per executor and window, relative to its block manager memory, with a GC mark."""
    used = tasks.filter("executor_id IS NOT NULL AND finish_ms IS NOT NULL").withColumn("w", F.window(F.expr("timestamp_millis(finish_ms)"), every))
    per = _agg(used, ["app_id", "executor_id", "w"], {"heap_used": "max(heap_bytes)", "gc_ms": "sum(gc_ms)", "run_ms": "sum(run_ms)"})
    cap = block_manager_capacity(block_managers).select("app_id", "executor_id", "max_onheap")
    pct = ratio("heap_used", "max_onheap") + " * 100D"
    return per.join(cap, ["app_id", "executor_id"], "left").selectExpr(
        "app_id", "executor_id", "unix_millis(w.start) AS window_start_ms", "heap_used", "max_onheap", f"{pct} AS used_percent",
        f"CASE WHEN {pct} > 90D THEN 'critical' WHEN {pct} > 80D THEN 'high' ELSE 'normal' END AS band",
        f"{ratio('gc_ms', 'run_ms')} > 0.1D AS gc_mark")
