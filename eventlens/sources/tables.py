"""Canonical tables from parsed events.

Input: events with ``app_id`` (see ``attach_app_ids``).  Every builder filters its own event types first, so on events
stored by type (``Corpus.load``) it reads only their files and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

TIME = "coalesce(Timestamp, Time)"


#: The log a file belongs to: the folder of a rolling log (its files may lie in folders roll=...), else the file itself.
LOG = "regexp_replace(file, '(/eventlog_v2_[^/]+)/(events_[0-9]+_|roll=[^/]+/)[^/]+$', '$1')"


def log_ids(events: DataFrame) -> DataFrame:
    """(log, app_id) of every log with a start event; one row per application."""
    starts = events.filter("Event = 'SparkListenerApplicationStart' AND `App ID` IS NOT NULL")
    return starts.groupBy(F.expr(LOG).alias("log")).agg(F.expr("min(`App ID`) AS app_id"))


def attach_app_ids(events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``app_id`` of each log: the id in its start event, else the base name of the file or rolling folder.

    ``ids`` (see ``log_ids``) may come from storage; else they are written there first.  Their size is then known before the
    join, which has no hint: the planner broadcasts them when they are small, so that no event is shuffled for its id, and
    otherwise splits the rows of large files across tasks.
    """
    ids = stash(log_ids(events)) if ids is None else ids
    base = "regexp_replace(regexp_replace(element_at(split(log, '/'), -1), '([.](json|ndjson|txt|gz|bz2|log))+$', ''), '^eventlog_v2_', '')"
    return events.withColumn("log", F.expr(LOG)).join(ids, "log", "left").withColumn("app_id", F.expr(f"coalesce(app_id, {base})")).drop("log")


def _of(events: DataFrame, *names: str) -> DataFrame:
    return events.filter(F.col("Event").isin(*["SparkListener" + n for n in names]))


def _metric(*paths: str, default: str = "0") -> str:
    """First value of the paths, looked up in the task metrics, then in the executor metrics.

    ``A+B`` is a sum of two fields that counts when either is present.
    """
    found = []
    for box in ("`Task Metrics`", "`Task Executor Metrics`"):
        for p in paths:
            parts = [box + "".join(f".`{x}`" for x in q.split("/")) for q in p.split("+")]
            if len(parts) == 1:
                found.append(parts[0])
            else:
                some = " OR ".join(f"{x} IS NOT NULL" for x in parts)
                found.append(f"CASE WHEN {some} THEN " + " + ".join(f"coalesce({x}, 0)" for x in parts) + " END")
    return f"coalesce({', '.join(found)}, {default})"


TASK_METRICS = {
    "run_ms": _metric("Executor Run Time", "ExecutorRunTime"), "cpu_ns": _metric("Executor CPU Time"),
    "gc_ms": _metric("JVM GC Time", "TotalGCTime", "JVMGCTime", "MinorGCTime+MajorGCTime"),
    "minor_gc_ms": _metric("MinorGCTime"), "major_gc_ms": _metric("MajorGCTime"), "deser_ms": _metric("Executor Deserialize Time"),
    "heap_bytes": _metric("JVMHeapMemory"), "offheap_bytes": _metric("JVMOffHeapMemory"), "result_bytes": _metric("Result Size"),
    "mem_spill_bytes": _metric("Memory Bytes Spilled", "Memory Spill Metrics/Spilled Bytes"), "disk_spill_bytes": _metric("Disk Bytes Spilled"),
    "sh_read_bytes": _metric("Shuffle Read Metrics/Total Bytes Read", "Shuffle Read Metrics/Shuffle Bytes Read",
                             "Shuffle Read Metrics/Remote Bytes Read+Shuffle Read Metrics/Local Bytes Read"),
    "fetch_wait_ms": _metric("Shuffle Read Metrics/Fetch Wait Time"), "sh_write_bytes": _metric("Shuffle Write Metrics/Shuffle Bytes Written"),
    "sh_write_time": _metric("Shuffle Write Metrics/Shuffle Write Time"), "sh_write_records": _metric("Shuffle Write Metrics/Shuffle Records Written"),
    "in_bytes": _metric("Input Metrics/Bytes Read"), "in_records": _metric("Input Metrics/Records Read"),
    "out_bytes": _metric("Output Metrics/Bytes Written"), "out_records": _metric("Output Metrics/Records Written"),
}


def tasks(events: DataFrame) -> DataFrame:
    """One row per finished task attempt."""
    t = "`Task Info`"
    return _of(events, "TaskEnd").selectExpr(
        "app_id", "`Stage ID` AS stage_id", "coalesce(`Stage Attempt ID`, 0) AS stage_attempt", f"{t}.`Task ID` AS task_id", f"coalesce({t}.Attempt, 0) AS attempt",
        f"{t}.`Executor ID` AS executor_id", f"{t}.Host AS host", f"{t}.Locality AS locality", f"coalesce({t}.Speculative, false) AS speculative",
        f"{t}.`Launch Time` AS launch_ms", f"{t}.`Finish Time` AS finish_ms",
        f"coalesce({t}.`Finish Time`, 0) - coalesce({t}.`Launch Time`, 0) AS duration_ms",
        "get_json_object(`Task End Reason`, '$.Reason') AS end_reason", "`Task End Reason` AS end_reason_json",
        *[f"{e} AS {n}" for n, e in TASK_METRICS.items()])


def task_starts(events: DataFrame) -> DataFrame:
    t = "`Task Info`"
    return _of(events, "TaskStart").selectExpr(
        "app_id", "`Stage ID` AS stage_id", "coalesce(`Stage Attempt ID`, 0) AS stage_attempt", f"{t}.`Task ID` AS task_id", f"coalesce({t}.Attempt, 0) AS attempt",
        f"{t}.`Launch Time` AS launch_ms", f"{t}.`Executor ID` AS executor_id")


def unfinished_tasks(starts: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("app_id", "stage_id", "stage_attempt", "task_id")) -> DataFrame:
    """Tasks that were launched but never ended."""
    return starts.join(ends.select(*keys), list(keys), "left_anti")


def stages(events: DataFrame) -> DataFrame:
    """One row per stage attempt, submission and completion combined in one aggregation."""
    s, sub = "`Stage Info`", "Event = 'SparkListenerStageSubmitted'"
    flat = _of(events, "StageSubmitted", "StageCompleted").selectExpr(
        "app_id", f"{s}.`Stage ID` AS stage_id", f"coalesce({s}.`Stage Attempt ID`, 0) AS attempt", f"{sub} AS is_sub",
        f"coalesce({s}.`Stage Name`, {s}.Name) AS name", f"coalesce({s}.`Number of Tasks`, {s}.`Num Tasks`) AS num_tasks",
        f"coalesce({s}.`Parent IDs`, array()) AS parent_ids", f"coalesce({s}.`RDD Info`.Name, array()) AS rdd_names",
        f"coalesce({s}.`Submission Time`, `Submission Time`, IF({sub}, {TIME}, NULL)) AS submission_ms",
        f"coalesce({s}.`Completion Time`, IF({sub}, NULL, {TIME})) AS completion_ms", f"{s}.`Failure Reason` AS failure_reason")
    out = flat.groupBy("app_id", "stage_id", "attempt").agg(
        F.expr("max_by(struct(name, num_tasks, parent_ids, rdd_names), is_sub) AS i"), F.expr("max(submission_ms) AS submission_ms"),
        F.expr("max(completion_ms) FILTER (WHERE NOT is_sub) AS completion_ms"), F.expr("max(failure_reason) FILTER (WHERE NOT is_sub) AS failure_reason"),
        F.expr("bool_or(is_sub) AS is_submitted"), F.expr("bool_or(NOT is_sub) AS is_completed"))
    return out.selectExpr("app_id", "stage_id", "attempt", "i.name", "i.num_tasks", "i.parent_ids", "i.rdd_names", "submission_ms", "completion_ms", "failure_reason",
                          "is_submitted", "is_completed",
                          "CASE WHEN NOT is_completed THEN 'SUBMITTED' WHEN length(failure_reason) > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status")


def jobs(events: DataFrame) -> DataFrame:
    """One row per started job; an end without a start is left out."""
    flat = _of(events, "JobStart", "JobEnd").selectExpr(
        "app_id", "`Job ID` AS job_id", "Event = 'SparkListenerJobStart' AS is_start", f"coalesce(`Submission Time`, {TIME}) AS submission_ms", "`Completion Time` AS completion_ms",
        "coalesce(`Stage IDs`, `Stage Infos`.`Stage ID`, array()) AS stage_ids", "`Job Result`.Result AS result")
    out = flat.groupBy("app_id", "job_id").agg(
        F.expr("max(submission_ms) FILTER (WHERE is_start) AS submission_ms"), F.expr("max(completion_ms) FILTER (WHERE NOT is_start) AS completion_ms"),
        F.expr("max_by(stage_ids, submission_ms) FILTER (WHERE is_start) AS stage_ids"), F.expr("max(result) FILTER (WHERE NOT is_start) AS result"),
        F.expr("bool_or(is_start) AS started"), F.expr("bool_or(NOT is_start) AS ended"))
    return out.filter("started").selectExpr("app_id", "job_id", "submission_ms", "completion_ms", "stage_ids", "result",
                                            "CASE WHEN NOT ended THEN 'RUNNING' WHEN result = 'JobFailed' THEN 'FAILED' ELSE 'SUCCESS' END AS status")


def executor_events(events: DataFrame) -> DataFrame:
    return _of(events, "ExecutorAdded", "ExecutorRemoved").selectExpr(
        "app_id", "`Executor ID` AS executor_id", "IF(Event = 'SparkListenerExecutorAdded', 'ADDED', 'REMOVED') AS kind", f"{TIME} AS ts_ms",
        "`Executor Info`.Host AS host", "`Executor Info`.`Total Cores` AS cores", "`Removed Reason` AS reason")


def block_managers(events: DataFrame) -> DataFrame:
    b, added = "`Block Manager ID`", "Event = 'SparkListenerBlockManagerAdded'"
    flat = _of(events, "BlockManagerAdded", "BlockManagerRemoved").selectExpr(
        "app_id", f"{b}.`Executor ID` AS executor_id", f"{b}.Host AS host", "`Maximum OnHeap Memory` AS on_heap", "`Maximum OffHeap Memory` AS off_heap",
        f"{TIME} AS ts_ms", f"{added} AS added")
    return flat.groupBy("app_id", "executor_id").agg(
        F.expr("max(host) AS host"), F.expr("max(on_heap) AS max_onheap"), F.expr("max(off_heap) AS max_offheap"),
        F.expr("min(ts_ms) FILTER (WHERE added) AS added_ms"), F.expr("max(ts_ms) FILTER (WHERE NOT added) AS removed_ms"))


def applications(events: DataFrame) -> DataFrame:
    """One row per application, also for logs without a start event.

    Duration is end minus start, NULL when either is missing.
    """
    start, end = "Event = 'SparkListenerApplicationStart'", "Event = 'SparkListenerApplicationEnd'"
    out = events.groupBy("app_id").agg(
        F.expr(f"max(`App Name`) FILTER (WHERE {start}) AS app_name"), F.expr(f"max(`User`) FILTER (WHERE {start}) AS user"),
        F.expr(f"max(`Spark Version`) FILTER (WHERE {start}) AS spark_version"), F.expr(f"min({TIME}) FILTER (WHERE {start}) AS start_ms"),
        F.expr(f"max({TIME}) FILTER (WHERE {end}) AS end_ms"))
    return out.selectExpr("*", "end_ms - start_ms AS duration_ms")


def environment(events: DataFrame) -> DataFrame:
    """(app_id, props) of the last environment update."""
    flat = _of(events, "EnvironmentUpdate").selectExpr("app_id", "`Spark Properties` AS props", f"coalesce({TIME}, 0) AS ts_ms")
    return flat.groupBy("app_id").agg(F.expr("max_by(props, ts_ms) AS props"))


def environment_props(env: DataFrame) -> DataFrame:
    """(app_id, key, value)."""
    return env.selectExpr("app_id", "explode(props) AS (key, value)")


def environment_columns(env: DataFrame, *keys: str) -> DataFrame:
    """Chosen properties as columns, dots replaced by underscores."""
    return env.selectExpr("app_id", *[f"props['{k}'] AS {k.replace('.', '_')}" for k in keys])


def raw_events(events: DataFrame) -> DataFrame:
    """(app_id, event) of every event."""
    return events.filter("Event IS NOT NULL").selectExpr("app_id", "Event AS event")
