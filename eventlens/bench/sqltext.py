"""Small builders of DuckDB SQL snippets used by the oracle statements."""

from __future__ import annotations

from eventlens.bench.views import duck_ctes
from eventlens.functions.text import BYTE_UNITS, FAILURE_PATTERNS, TRANSFORMATIONS


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def num(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def pct(x: str, digits: int = 1) -> str:
    return f"({num(f'CAST({x} AS DOUBLE) * 100', digits)} || '%')"


def fbytes(x: str, short_zero: bool = False) -> str:
    v = f"CAST({x} AS DOUBLE)"
    arms = " ".join(f"WHEN {v} < {1024**(k + 1)} THEN {num(f'{v} / {1024**k}', 2)} || ' {BYTE_UNITS[k]}'" for k in range(5))
    zero = f"WHEN {v} = 0 THEN '0 B' " if short_zero else ""
    return f"(CASE {zero}{arms} ELSE {num(f'{v} / {1024**5}', 2)} || ' PB' END)"


def fdur(x: str, seconds_in_hours: bool = False) -> str:
    s = f"CAST(floor(CAST({x} AS DOUBLE) / 1000) AS BIGINT)"
    tail = f" || ' ' || ({s} % 60) || 's'" if seconds_in_hours else ""
    return (f"(CASE WHEN {x} < 1000 THEN {num(x, 0)} || 'ms' WHEN {x} < 60000 THEN {num(f'{x} / 1000.0', 1)} || 's' "
            f"WHEN {x} < 3600000 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' "
            f"ELSE ({s} // 3600) || 'h ' || (({s} // 60) % 60) || 'm'{tail} END)")


def rank(x: str) -> str:
    return f"(CASE {x} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END)"


def classify(x: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({x}, '{p}', 'i') THEN '{n}'" for n, p in FAILURE_PATTERNS)
    return f"(CASE {arms} ELSE 'UNKNOWN' END)"


def executor_failed(x: str) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), 'lost|failed|killed|error')"


def transformation(name: str, part: int) -> str:
    """part 0: type, 1: operation."""
    arms = []
    for kind, patterns in reversed(TRANSFORMATIONS):
        for p in patterns:
            arms.append(f"WHEN contains(lower({name}), '{p.lower()}') THEN '{kind if part == 0 else p}'")
    return f"(CASE {' '.join(arms)} ELSE 'unknown' END)"


# application metrics as CTEs; ``m`` has the same columns as the Spark table
METRIC_CTES = f"""
mq AS (SELECT app_id, count(*) AS total_tasks, avg(duration_ms) AS mean_task_duration,
    coalesce(stddev_samp(duration_ms), 0) AS std_task_duration, min(duration_ms) AS min_task_duration,
    max(duration_ms) AS max_task_duration, quantile_cont(duration_ms, 0.25) AS p25, quantile_cont(duration_ms, 0.5) AS p50,
    quantile_cont(duration_ms, 0.75) AS p75, quantile_cont(duration_ms, 0.9) AS p90, quantile_cont(duration_ms, 0.95) AS p95,
    quantile_cont(duration_ms, 0.99) AS p99 FROM tasks WHERE duration_ms > 0 GROUP BY 1),
ms AS (SELECT app_id, sum(cpu_ns) / 1e6 AS cpu_ms, sum(run_ms) AS total_run_time_ms, sum(deser_ms) AS total_deserialize_time_ms,
    sum(gc_ms) AS total_gc_time_ms, sum(minor_gc_ms) AS minor_gc_time_ms, sum(major_gc_ms) AS major_gc_time_ms,
    avg(heap_bytes) AS avg_heap, max(heap_bytes) AS max_heap, sum(heap_bytes) AS total_heap, avg(offheap_bytes) AS avg_offheap,
    max(offheap_bytes) AS max_offheap, sum(offheap_bytes) AS total_offheap,
    sum(mem_spill_bytes) AS memory_bytes_spilled, sum(disk_spill_bytes) AS disk_bytes_spilled,
    count(*) FILTER (mem_spill_bytes > 0) AS tasks_with_spill, sum(in_bytes) AS input_bytes, sum(out_bytes) AS output_bytes,
    sum(in_records) AS input_records, sum(out_records) AS output_records, count(*) FILTER (in_bytes > 0) AS tasks_with_input,
    count(*) FILTER (out_bytes > 0) AS tasks_with_output, sum(sh_read_bytes) AS shuffle_read_bytes,
    sum(sh_write_bytes) AS shuffle_write_bytes, sum(fetch_wait_ms) AS shuffle_time_ms,
    count(*) FILTER (sh_read_bytes > 0) AS tasks_with_shuffle_read, count(*) FILTER (sh_write_bytes > 0) AS tasks_with_shuffle_write,
    sum(sh_write_time) AS shuffle_write_time_ms, sum(sh_write_records) AS shuffle_records_written,
    CASE WHEN stddev_samp(gc_ms) * stddev_samp(duration_ms) > 0 THEN corr(gc_ms, duration_ms) ELSE 0 END AS gc_vs_duration,
    CASE WHEN stddev_samp(mem_spill_bytes) * stddev_samp(gc_ms) > 0 THEN corr(mem_spill_bytes, gc_ms) ELSE 0 END AS spill_vs_gc,
    CASE WHEN stddev_samp(fetch_wait_ms) * stddev_samp(duration_ms) > 0 THEN corr(fetch_wait_ms, duration_ms) ELSE 0 END AS shuffle_vs_duration
    FROM tasks GROUP BY 1),
mst AS (SELECT t.app_id, count(*) AS stragglers_count FROM tasks t JOIN mq USING (app_id)
    WHERE t.duration_ms > 0 AND t.duration_ms > p75 + 1.5 * (p75 - p25) GROUP BY 1),
mec AS (SELECT app_id, executor_id, count(*) AS tasks FROM tasks WHERE executor_id IS NOT NULL GROUP BY 1, 2),
me AS (SELECT app_id, count(*) AS total_executors, min(tasks) AS min_tasks_per_executor, max(tasks) AS max_tasks_per_executor,
    avg(tasks) AS mean_tasks_per_executor, stddev_pop(tasks) / avg(tasks) AS executor_imbalance_ratio,
    (max(tasks) - min(tasks)) / avg(tasks) * 100 AS load_imbalance_percentage FROM mec GROUP BY 1),
mfs AS (SELECT app_id, stage_id, count(*) AS attempts, count(failure_reason) AS failed, max(attempt) > 0 AS retried FROM stages GROUP BY 1, 2),
mf AS (SELECT app_id, count(*) AS total_stages, {big('sum(attempts)')} AS stage_attempts, {big('sum(failed)')} AS failed_stages,
    count(*) FILTER (retried) AS retried_stages, {div('sum(failed)', 'sum(attempts)')} AS failure_rate FROM mfs GROUP BY 1),
mx AS (SELECT app_id, count(*) FILTER (kind = 'ADDED') AS executors_added, count(*) FILTER (kind = 'REMOVED') AS executors_removed,
    count(*) FILTER (kind = 'REMOVED') > 0 AS has_executor_loss FROM executor_events GROUP BY 1),
mj AS (SELECT app_id, count(completion_ms) AS total_jobs FROM jobs GROUP BY 1),
m AS (SELECT p.app_id, p.app_name, coalesce(p.duration_ms, 0) AS application_duration_ms, mq.* EXCLUDE (app_id), ms.* EXCLUDE (app_id),
    me.* EXCLUDE (app_id), mf.* EXCLUDE (app_id), mx.* EXCLUDE (app_id), mj.total_jobs,
    p50 AS median_task_duration, max_task_duration - min_task_duration AS duration_range,
    p75 + 1.5 * (p75 - p25) AS outlier_threshold, coalesce(stragglers_count, 0) AS stragglers_count,
    {div('coalesce(stragglers_count, 0)', 'total_tasks')} * 100 AS stragglers_percentage,
    {div('std_task_duration', 'mean_task_duration')} AS task_skew_ratio,
    {div('std_task_duration', 'mean_task_duration')} AS coefficient_of_variation,
    {div('cpu_ms', 'total_run_time_ms')} AS cpu_efficiency,
    CASE WHEN total_run_time_ms > 0 THEN 1 - {div('cpu_ms', 'total_run_time_ms')} ELSE 0 END AS cpu_wait_ratio,
    CAST(floor(cpu_ms) AS BIGINT) AS total_cpu_time_ms,
    {div('total_deserialize_time_ms', 'total_run_time_ms')} * 100 AS deserialize_overhead_percentage,
    {div('total_gc_time_ms', 'total_run_time_ms')} AS gc_overhead_ratio,
    CASE WHEN {div('total_gc_time_ms', 'total_run_time_ms')} > 0.4 THEN 'CRITICAL'
         WHEN {div('total_gc_time_ms', 'total_run_time_ms')} > 0.2 THEN 'HIGH'
         WHEN {div('total_gc_time_ms', 'total_run_time_ms')} > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS gc_pressure_level,
    memory_bytes_spilled + disk_bytes_spilled AS total_spilled, {div('memory_bytes_spilled', 'input_bytes')} AS spill_ratio,
    shuffle_read_bytes + shuffle_write_bytes AS total_shuffle_bytes, {div('shuffle_time_ms', 'total_run_time_ms')} AS shuffle_ratio,
    {div('shuffle_write_time_ms', 'total_run_time_ms')} AS shuffle_time_ratio,
    1 - least({div('shuffle_time_ms', 'total_run_time_ms')}, 1) AS shuffle_efficiency
  FROM applications p LEFT JOIN mq USING (app_id) LEFT JOIN ms USING (app_id) LEFT JOIN mst USING (app_id) LEFT JOIN me USING (app_id)
  LEFT JOIN mf USING (app_id) LEFT JOIN mx USING (app_id) LEFT JOIN mj USING (app_id))"""


def query(sql: str, *extra: str) -> str:
    """A full statement: canonical tables, application metrics, further CTEs, then the select."""
    parts = [duck_ctes().strip(), METRIC_CTES.strip(), *[e.strip() for e in extra]]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
