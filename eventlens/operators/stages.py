"""Stage and job analysis.

Task rows are reduced once to (application, stage); everything after works on stage-sized tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.graph import lifts, longest_walks, reached
from eventlens.functions.text import WIDE_TYPES, format_bytes, format_duration, links, num, percent, ratio, severity_rank, transformation
from eventlens.operators import parts
from eventlens.plans.stash import stash

# Issue type -> report category
ISSUE_CATEGORIES = {"HIGH_GC": "gc_pressure_stages", "DATA_SKEW": "data_skew_stages", "MEMORY_SPILL": "memory_spill_stages",
                    "EXCESSIVE_SHUFFLE": "shuffle_heavy_stages", "STAGE_FAILURE": "failed_stages"}


def _agg(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"{e} AS {n}") for n, e in aggs.items()])


def stage_table(stages: DataFrame) -> DataFrame:
    """One row per stage: the latest submission and the completion that belongs to it.

    Input rows are stage attempts.  A completion of an earlier attempt than the latest submission
    does not close the stage; a completion that was never submitted is kept with its own status.
    """
    info = "named_struct('attempt', attempt, 'name', name, 'num_tasks', num_tasks, 'parent_ids', parent_ids, 'rdd_names', rdd_names, 'submission_ms', submission_ms)"
    done = "named_struct('attempt', attempt, 'completion_ms', completion_ms, 'failure_reason', failure_reason)"
    picked = _agg(stages, ["app_id", "stage_id"], {
        "s": f"max_by({info}, struct(attempt, submission_ms)) FILTER (WHERE is_submitted)",
        "o": f"max_by({info}, struct(attempt, completion_ms)) FILTER (WHERE is_completed)",
        "c": f"max_by({done}, struct(attempt, completion_ms)) FILTER (WHERE is_completed)"})
    closed = "c IS NOT NULL AND (s IS NULL OR c.attempt >= s.attempt)"
    return picked.selectExpr("app_id", "stage_id", "coalesce(s, o) AS i", f"CASE WHEN {closed} THEN c END AS c", "s IS NULL AS is_orphan").selectExpr(
        "app_id", "stage_id", "i.attempt AS stage_attempt", "coalesce(i.name, '') AS stage_name", "i.num_tasks", "i.parent_ids", "i.rdd_names",
        "i.submission_ms", "c.completion_ms", "c.failure_reason",
        "CASE WHEN c IS NULL THEN 'SUBMITTED' WHEN length(c.failure_reason) > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status", "is_orphan")


def job_table(jobs: DataFrame) -> DataFrame:
    return jobs.selectExpr(
        "app_id", "job_id", "submission_ms", "completion_ms", "stage_ids", "result",
        "CASE WHEN completion_ms IS NULL AND result IS NULL THEN 'RUNNING' WHEN result = 'JobFailed' THEN 'FAILED' ELSE 'SUCCESS' END AS status")


STAGE_SUMS = {
    "total_tasks": "count(1)",
    "total_duration_ms": "coalesce(sum(duration_ms) FILTER (WHERE duration_ms > 0), 0)",
    "mean_task_duration_ms": "coalesce(avg(duration_ms) FILTER (WHERE duration_ms > 0), 0D)",
    "max_task_duration_ms": "coalesce(max(duration_ms) FILTER (WHERE duration_ms > 0), 0)",
    "min_task_duration_ms": "coalesce(min(duration_ms) FILTER (WHERE duration_ms > 0), 0)",
    "total_gc_time_ms": "coalesce(sum(gc_ms), 0)", "total_memory_spilled": "coalesce(sum(mem_spill_bytes), 0)",
    "total_shuffle_read": "coalesce(sum(sh_read_bytes), 0)", "total_input": "coalesce(sum(in_bytes), 0)",
}


def stage_metrics(tasks: DataFrame) -> DataFrame:
    """Task figures per stage over all attempts; skew is (max - min) / mean, GC is relative to task duration."""
    return _stage_ratios(_agg(tasks, ["app_id", "stage_id"], STAGE_SUMS))


def stage_metrics_of_parts(task_parts: DataFrame) -> DataFrame:
    """``stage_metrics`` from the parts of the tasks (see ``parts``)."""
    keys = ["app_id", "stage_id"]
    return _stage_ratios(parts.combined(task_parts, keys, moments=False).selectExpr(*keys, *[f"{e} AS {n}" for n, e in parts.STAGE_SUMS.items()]))


def _stage_ratios(sums: DataFrame) -> DataFrame:
    return sums.selectExpr(
        "app_id", "stage_id", "total_tasks", "total_duration_ms", "mean_task_duration_ms", "max_task_duration_ms", "min_task_duration_ms",
        ratio("max_task_duration_ms - min_task_duration_ms", "mean_task_duration_ms") + " AS task_skew", "total_gc_time_ms",
        ratio("total_gc_time_ms", "total_duration_ms") + " AS gc_ratio", "total_memory_spilled", "total_shuffle_read",
        ratio("total_shuffle_read", "total_shuffle_read + total_input") + " AS shuffle_ratio")


def _issue(kind: str, severity: str, description: str, metric: str, value: str) -> str:
    return (f"named_struct('type', '{kind}', 'severity', {severity}, 'description', {description}, 'metric', '{metric}', "
            f"'value', CAST({value} AS DOUBLE))")


# Fixed texts: descriptions of the issues, in the order in which they are checked
STRAGGLER = ratio("max_task_duration_ms", "mean_task_duration_ms")
ISSUES = links(
    ("gc_ratio > 0.2D", _issue("HIGH_GC", "IF(gc_ratio > 0.3D, 'HIGH', 'MEDIUM')",
                               f"concat('High GC overhead: ', {percent('gc_ratio')}, ' of stage time')", "gc_ratio", "gc_ratio")),
    ("task_skew > 0.5D", _issue("DATA_SKEW", "IF(task_skew > 1.0D, 'HIGH', 'MEDIUM')",
                                f"concat('Data skew detected: task duration variance ', {percent('task_skew')})", "task_skew", "task_skew")),
    ("total_memory_spilled > 100000000", _issue("MEMORY_SPILL", "IF(total_memory_spilled > 1000000000, 'HIGH', 'MEDIUM')",
                                                f"concat('Memory spill: ', {format_bytes('total_memory_spilled')})", "total_memory_spilled", "total_memory_spilled")),
    ("shuffle_ratio > 0.5D", _issue("EXCESSIVE_SHUFFLE", "'HIGH'", f"concat('Excessive shuffle: ', {percent('shuffle_ratio')}, ' of data')",
                                    "shuffle_ratio", "shuffle_ratio")),
    ("mean_task_duration_ms > 0 AND max_task_duration_ms > mean_task_duration_ms * 2",
     _issue("STRAGGLER_TASKS", "'MEDIUM'", f"concat('Straggler tasks detected: max task is ', {num(STRAGGLER, 1)}, 'x slower than mean')",
            "max_vs_mean_ratio", STRAGGLER)),
    ("total_tasks > 0 AND status = 'FAILED'", _issue("STAGE_FAILURE", "'CRITICAL'", "concat('Stage failed: ', coalesce(failure_reason, 'Unknown'))",
                                                     "failure", "NULL")),
)

_ZERO = ("total_tasks", "total_duration_ms", "mean_task_duration_ms", "max_task_duration_ms", "min_task_duration_ms", "task_skew",
         "total_gc_time_ms", "gc_ratio", "total_memory_spilled", "total_shuffle_read", "shuffle_ratio")


def stage_details(stages: DataFrame, tasks: DataFrame, task_parts: DataFrame | None = None) -> DataFrame:
    """Stages left-joined with their task figures, transformation and ordered issues.

    A stage without tasks has zero figures and no issues. With ``task_parts`` (see ``parts``) the tasks are not read.
    """
    wide = ", ".join(f"'{t}'" for t in WIDE_TYPES)
    joined = stage_table(stages).join(stage_metrics(tasks) if task_parts is None else stage_metrics_of_parts(task_parts), ["app_id", "stage_id"], "left")
    keep = [c for c in joined.columns if c not in _ZERO]
    return joined.selectExpr(*keep, *[f"coalesce({c}, 0) AS {c}" for c in _ZERO], f"{transformation('stage_name')} AS t").selectExpr(
        *keep, *_ZERO, "t.type AS transformation_type", "t.operation", f"t.type IN ({wide}) AS is_wide_transformation",
        "contains(lower(stage_name), 'shuffle') OR contains(lower(stage_name), 'exchange') AS is_shuffle_stage", f"{ISSUES} AS issues")


def stage_issues(details: DataFrame) -> DataFrame:
    """One row per issue; ``pos`` is the order in which the rules are checked."""
    return details.selectExpr("app_id", "stage_id", "posexplode(issues) AS (pos, i)").selectExpr("app_id", "stage_id", "pos", "i.*")


def stage_transformation(stages: DataFrame) -> DataFrame:
    wide = ", ".join(f"'{t}'" for t in WIDE_TYPES)
    return stage_table(stages).selectExpr("app_id", "stage_id", "stage_name", "rdd_names", f"{transformation('stage_name')} AS t").selectExpr(
        "app_id", "stage_id", "stage_name", "t.type AS transformation_type", "t.operation", "rdd_names",
        "contains(lower(stage_name), 'shuffle') OR contains(lower(stage_name), 'exchange') AS is_shuffle_stage",
        f"t.type IN ({wide}) AS is_wide_transformation")


def stage_task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks, distinct executors, speculative tasks and the locality histogram per stage."""
    fine = _agg(tasks, ["app_id", "stage_id", "executor_id", "locality"], {"n": "count(1)", "spec": "count_if(speculative)"})
    totals = _agg(fine, ["app_id", "stage_id"], {"total_tasks": "sum(n)", "unique_executors": "count(DISTINCT executor_id)", "speculative_tasks": "sum(spec)"})
    local = _agg(fine.filter("locality IS NOT NULL"), ["app_id", "stage_id", "locality"], {"n": "sum(n)"})
    hist = _agg(local, ["app_id", "stage_id"], {"locality_distribution": "map_from_entries(array_sort(collect_list(struct(locality, n))))"})
    return totals.join(hist, ["app_id", "stage_id"], "left")


def job_stages(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """(app_id, job_id, stage_id) for the stages that occur in the log."""
    pairs = jobs.selectExpr("app_id", "job_id", "explode(stage_ids) AS stage_id")
    return pairs.join(stage_table(stages).select("app_id", "stage_id", "stage_name", "status"), ["app_id", "stage_id"])


def job_metrics(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Totals over the stages of a job; the id lists are at most as long as the job's own stage list."""
    job = job_table(jobs)
    pairs = job.selectExpr("app_id", "job_id", "explode(stage_ids) AS stage_id")
    slim = details.selectExpr("app_id", "stage_id", "status", "total_duration_ms", "total_tasks", "size(issues) > 0 AS bad")
    sums = _agg(pairs.join(slim, ["app_id", "stage_id"]), ["app_id", "job_id"], {
        "total_duration_ms": "sum(total_duration_ms)", "total_tasks": "sum(total_tasks)",
        "failed_stages": "array_sort(collect_list(stage_id) FILTER (WHERE status = 'FAILED'))",
        "problematic_stages": "array_sort(collect_list(stage_id) FILTER (WHERE bad))"})
    return job.join(sums, ["app_id", "job_id"], "left").selectExpr(
        "app_id", "job_id", "status", "size(stage_ids) AS total_stages", "stage_ids", "coalesce(total_duration_ms, 0) AS total_duration_ms",
        "coalesce(total_tasks, 0) AS total_tasks", "coalesce(failed_stages, array()) AS failed_stages",
        "coalesce(problematic_stages, array()) AS problematic_stages", "submission_ms", "completion_ms")


def max_severity(issues: str = "issues") -> str:
    return f"array_min(transform({issues}, i -> {severity_rank('i.severity')}))"


def problem_transformations(details: DataFrame) -> DataFrame:
    """Stages with issues, their transformation and worst severity (``sev_rank`` gives the order)."""
    return details.filter("size(issues) > 0").selectExpr(
        "app_id", "stage_id", "stage_name", "transformation_type", "operation", "is_wide_transformation", "issues",
        f"{max_severity()} AS sev_rank").selectExpr("*", "element_at(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'), sev_rank + 1) AS severity")


def bottleneck_mapping(details: DataFrame) -> DataFrame:
    """(app_id, category, stage_id) rows, so a category may hold any number of stages."""
    arms = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in ISSUE_CATEGORIES.items())
    return stage_issues(details).selectExpr("app_id", f"CASE type {arms} END AS category", "stage_id").filter("category IS NOT NULL")


def stage_hotspots(details: DataFrame, top: int = 10) -> DataFrame:
    """The stages with the largest total task duration per application."""
    ranked = details.filter("total_duration_ms > 0").selectExpr(
        "app_id", "stage_id", "stage_name", "total_duration_ms AS duration_ms", f"{format_duration('total_duration_ms')} AS duration_formatted",
        "total_tasks AS task_count", "size(issues) AS issue_count", "transformation_type",
        "row_number() OVER (PARTITION BY app_id ORDER BY total_duration_ms DESC, stage_id) AS rank")
    return ranked.filter(f"rank <= {int(top)}")


def stage_summary(details: DataFrame) -> DataFrame:
    out = _agg(details, ["app_id"], {
        "total_stages": "count(1)", "failed_stages": "count_if(status = 'FAILED')", "stages_with_issues": "count_if(size(issues) > 0)",
        "healthy_stages": "count_if(size(issues) = 0)", "total_duration_ms": "sum(total_duration_ms)"})
    return out.selectExpr("*", f"{format_duration('total_duration_ms')} AS total_duration_formatted")


def job_summary(jobs: DataFrame) -> DataFrame:
    return _agg(job_table(jobs), ["app_id"], {"total_jobs": "count(1)", "failed_jobs": "count_if(status = 'FAILED')",
                                              "successful_jobs": "count_if(status <> 'FAILED')"})


def stage_edges(stages: DataFrame) -> DataFrame:
    """(app_id, stage_id, parent_id) of the parents named by each stage, whatever their ids."""
    return stage_table(stages).selectExpr("app_id", "stage_id", "explode(parent_ids) AS parent_id").filter("parent_id IS NOT NULL").distinct()


def stage_lineage(stages: DataFrame) -> DataFrame:
    """Parent edges with the parent's status, the depth of the stage (longest path from a root) and a cycle flag.

    Damaged logs may hold a cycle: stages on it, or with an ancestor on it, have no depth and ``cyclic`` is true. The number
    of rounds grows with the logarithm of the depth (see ``functions.graph``).
    """
    table = stage_table(stages).selectExpr("app_id", "stage_id AS parent_id", "status AS parent_status")
    edges = stash(stage_edges(stages))
    steps, most = lifts(edges, "app_id", "stage_id", "parent_id")
    if not steps:
        return stages.sparkSession.createDataFrame([], "app_id STRING, stage_id BIGINT, parent_id BIGINT, parent_status STRING, depth BIGINT, cyclic BOOLEAN")
    depths = longest_walks(steps, most, "app_id", "stage_id", "parent_id")
    return edges.join(depths, ["app_id", "stage_id"]).join(table, ["app_id", "parent_id"], "left").select(
        "app_id", "stage_id", "parent_id", "parent_status", "depth", "cyclic")


def ancestors_of(stages: DataFrame, wanted: DataFrame, hops: int | None = None) -> DataFrame:
    """(app_id, stage_id, ancestor_id, hops) of the stages in ``wanted`` (app_id, stage_id), with the least number of edges.

    ``hops`` bounds the number of edges. A stage that is its own ancestor lies on a cycle.
    """
    steps, _ = lifts(stage_edges(stages), "app_id", "stage_id", "parent_id")
    return reached(steps, wanted, "app_id", "stage_id", "parent_id", hops).withColumnRenamed("parent_id", "ancestor_id")


def stage_gc_series(details: DataFrame) -> DataFrame:
    """GC share per stage with its colour band, for a bar chart."""
    pct = "gc_ratio * 100D"
    return details.selectExpr("app_id", "stage_id", "concat('Stage ', stage_id) AS label", f"{pct} AS gc_percent",
                              f"CASE WHEN {pct} > 25 THEN 'critical' WHEN {pct} > 15 THEN 'high' WHEN {pct} > 10 THEN 'medium' ELSE 'low' END AS band")


def stage_shuffle_series(tasks: DataFrame) -> DataFrame:
    """Fetch wait plus write time per stage, for a bar chart."""
    return _agg(tasks, ["app_id", "stage_id"], {"fetch_wait_ms": "coalesce(sum(fetch_wait_ms), 0)", "write_time_ms": "coalesce(sum(sh_write_time), 0)"}).selectExpr(
        "app_id", "stage_id", "concat('Stage ', stage_id) AS label", "fetch_wait_ms + write_time_ms AS shuffle_time_ms")
