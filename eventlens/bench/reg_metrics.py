"""Registry of application-level metric queries."""

from eventlens.bench import views as v
from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, query, r6
from eventlens.operators import metrics as M
from eventlens.operators import parts as P
from eventlens.plans.stash import stash


def _r(*names):
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


def _b(*names):
    return ", ".join(f"{big(n)} AS {n}" for n in names)


register("task_stats", lambda s, d: M.task_stats(v.tasks(s, d)), query(
    f"SELECT app_id, {_b('total_tasks', 'min_task_duration', 'max_task_duration', 'duration_range')}, "
    f"{_r('mean_task_duration', 'std_task_duration', 'median_task_duration')} FROM m"))
register("task_percentiles", lambda s, d: M.task_percentiles(v.tasks(s, d)), query(
    f"SELECT app_id, {_r('p25', 'p50', 'p75', 'p90', 'p95', 'p99')} FROM m"))
register("task_percentiles_approx", lambda s, d: M.approximate_quantiles(v.tasks(s, d)))
_P = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# sketches of stages, merged to applications: every rank must lie within the bound
register("sketch_rank_errors", lambda s, d: M.sketch_rank_errors(v.tasks(s, d), stash(M.duration_sketches(v.tasks(s, d)))).drop("rank_error"), query(
    "SELECT app_id, name, count(*) AS total, true AS within_bound FROM tasks, (SELECT unnest([" + ", ".join(f"'{n}'" for n in _P) + "]) AS name) WHERE duration_ms > 0 GROUP BY 1, 2"))
register("task_skew_ratio", lambda s, d: M.task_skew_ratio(v.tasks(s, d)), query(
    f"SELECT app_id, {_r('task_skew_ratio', 'coefficient_of_variation')} FROM m"))
register("stragglers_iqr", lambda s, d: M.stragglers(v.tasks(s, d)), query(
    f"SELECT app_id, {_b('stragglers_count')}, {_r('outlier_threshold', 'stragglers_percentage')} FROM m"))
register("cpu_metrics", lambda s, d: M.metric_group(v.tasks(s, d), "cpu").drop("total_deserialize_time_ms", "deserialize_overhead_percentage"), query(
    f"SELECT app_id, {_b('total_run_time_ms', 'total_cpu_time_ms')}, {_r('cpu_efficiency', 'cpu_wait_ratio')}, "
    f"{r6('cpu_efficiency * 100')} AS cpu_utilization_percentage, {r6('cpu_wait_ratio * 100')} AS cpu_wait_percentage FROM m"))
register("deserialize_overhead", lambda s, d: M.metric_group(v.tasks(s, d), "cpu").select(
    "app_id", "total_deserialize_time_ms", "deserialize_overhead_percentage"), query(
    f"SELECT app_id, {_b('total_deserialize_time_ms')}, {_r('deserialize_overhead_percentage')} FROM m"))
register("memory_heap", lambda s, d: M.metric_group(v.tasks(s, d), "heap"), query(
    f"SELECT app_id, {big('floor(avg_heap)')} AS avg_heap, {big('floor(avg_offheap)')} AS avg_offheap, "
    f"{_b('max_heap', 'total_heap', 'max_offheap', 'total_offheap')} FROM m"))
register("gc_overhead", lambda s, d: M.metric_group(v.tasks(s, d), "gc").drop("gc_pressure_level"), query(
    f"SELECT app_id, {_b('total_gc_time_ms', 'minor_gc_time_ms', 'major_gc_time_ms', 'total_run_time_ms')}, "
    f"{_r('gc_overhead_ratio')}, {r6('gc_overhead_ratio * 100')} AS gc_overhead_percentage FROM m"))
register("gc_pressure_level", lambda s, d: M.metric_group(v.tasks(s, d), "gc").select("app_id", "gc_pressure_level"),
         query("SELECT app_id, gc_pressure_level FROM m"))
register("spill_metrics", lambda s, d: M.metric_group(v.tasks(s, d), "spill").drop("input_bytes"), query(
    f"SELECT app_id, {_b('memory_bytes_spilled', 'disk_bytes_spilled', 'total_spilled', 'tasks_with_spill')}, {_r('spill_ratio')} FROM m"))
register("shuffle_write", lambda s, d: M.metric_group(v.tasks(s, d), "shuffle").select(
    "app_id", "shuffle_write_bytes", "shuffle_write_time_ms", "shuffle_records_written", "tasks_with_shuffle_write",
    "shuffle_time_ratio", "shuffle_write_percentage"), query(
    f"SELECT app_id, {_b('shuffle_write_bytes', 'shuffle_write_time_ms', 'shuffle_records_written', 'tasks_with_shuffle_write')}, "
    f"{_r('shuffle_time_ratio')}, {r6('shuffle_time_ratio * 100')} AS shuffle_write_percentage FROM m"))
register("shuffle_read", lambda s, d: M.metric_group(v.tasks(s, d), "shuffle").select(
    "app_id", "shuffle_read_bytes", "total_shuffle_bytes", "shuffle_time_ms", "tasks_with_shuffle_read", "shuffle_ratio",
    "shuffle_time_percentage"), query(
    f"SELECT app_id, {_b('shuffle_read_bytes', 'total_shuffle_bytes', 'shuffle_time_ms', 'tasks_with_shuffle_read')}, "
    f"{_r('shuffle_ratio')}, {r6('shuffle_ratio * 100')} AS shuffle_time_percentage FROM m"))
register("shuffle_efficiency", lambda s, d: M.metric_group(v.tasks(s, d), "shuffle").select("app_id", "shuffle_efficiency"),
         query(f"SELECT app_id, {_r('shuffle_efficiency')} FROM m"))
register("io_metrics", lambda s, d: M.metric_group(v.tasks(s, d), "io"), query(
    f"SELECT app_id, {_b('input_bytes', 'output_bytes', 'input_records', 'output_records', 'tasks_with_input', 'tasks_with_output')} FROM m"))
register("executor_task_counts", lambda s, d: M.executor_task_counts(v.tasks(s, d)),
         query("SELECT app_id, executor_id, tasks FROM mec"))
register("executor_imbalance", lambda s, d: M.executor_imbalance(v.tasks(s, d)), query(
    f"SELECT app_id, total_executors, min_tasks_per_executor, max_tasks_per_executor, "
    f"{_r('mean_tasks_per_executor', 'executor_imbalance_ratio', 'load_imbalance_percentage')} FROM me"))
register("executor_churn", lambda s, d: M.executor_churn(v.executor_events(s, d)), query("SELECT * FROM mx"))
register("removal_reasons", lambda s, d: M.removal_reasons(v.executor_events(s, d)), query(
    "SELECT app_id, coalesce(reason, '') AS reason, count(*) AS removals FROM executor_events WHERE kind = 'REMOVED' GROUP BY 1, 2"))
register("app_duration", lambda s, d: M.app_duration(v.applications(s, d)), query(
    "SELECT app_id, app_name, start_ms, end_ms, duration_ms AS application_duration_ms FROM applications"))
register("stage_failure_rate", lambda s, d: M.stage_failure_rate(v.stages(s, d)), query(
    f"SELECT app_id, total_stages, stage_attempts, failed_stages, retried_stages, {_r('failure_rate')} FROM mf"))
register("correlations", lambda s, d: M.correlations(v.tasks(s, d)), query(
    f"SELECT app_id, {_r('gc_vs_duration', 'spill_vs_gc', 'shuffle_vs_duration')} FROM m"))
_TH = """th AS (SELECT app_id, 'task_duration_ms' AS metric, duration_ms AS x FROM tasks
  UNION ALL SELECT app_id, 'task_gc_ratio', CASE WHEN run_ms = 0 THEN 0 ELSE CAST(gc_ms AS DOUBLE) / run_ms END FROM tasks
  UNION ALL SELECT app_id, 'task_spill_bytes', mem_spill_bytes FROM tasks)"""
register("dynamic_thresholds", lambda s, d: M.dynamic_thresholds(v.tasks(s, d)), query(
    f"SELECT app_id, metric, {r6('quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))')} AS outlier_fence, "
    f"{r6('quantile_cont(x, 0.95)')} AS p95 FROM th GROUP BY 1, 2", _TH))
_LONG = " UNION ALL ".join(f"SELECT app_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM m" for n in M.LONG_METRICS)
LONG_CTE = f"ml AS ({_LONG})"
register("metrics_long", lambda s, d: M.metrics_long(M.app_metrics(v.BenchCorpus(s, d))), query(f"SELECT app_id, metric, {r6('value')} AS value FROM ml", LONG_CTE))


def _in_two_logs(s, d):
    """Metrics of parts stored for some tasks, to which the others are added; most stages and executors have tasks in both."""
    t = v.tasks(s, d)
    old, new = (stash(P.task_parts(t.filter(f"task_id % 3 {x} 0"))) for x in ("=", "<>"))
    whole = M.metrics_of_parts(P.added(old, new), *M.TASK_GROUPS)
    names = [n for n in M.LONG_METRICS if n in whole.columns]
    return whole.selectExpr("app_id", f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, CAST({n} AS DOUBLE)' for n in names)}) AS (metric, value)")


_PART_METRICS = [n for n in M.LONG_METRICS if n in {k for g in P.AGGREGATES.values() for k in g} | {k for g in M._derived("ns").values() for k in g}]
register("metrics_added", _in_two_logs, query(
    f"SELECT app_id, metric, {r6('value')} AS value FROM ml WHERE metric IN (" + ", ".join(f"'{n}'" for n in _PART_METRICS) + ")", LONG_CTE))
_SUMS = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in M.ROLLUP_SUMS)
register("rollup_metrics", lambda s, d: M.rollup_metrics(v.tasks(s, d)), query(
    f"""SELECT CASE WHEN grouping(stage_id) = 1 AND grouping(executor_id) = 1 THEN 'app' WHEN grouping(executor_id) = 1 THEN 'stage'
    ELSE 'executor' END AS grain, app_id, stage_id, executor_id, count(*) AS tasks, {_SUMS} FROM tasks
    GROUP BY GROUPING SETS ((app_id), (app_id, stage_id), (app_id, executor_id))"""))
