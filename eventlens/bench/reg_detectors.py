"""Registry of detector queries."""

from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, div, fbytes, num, pct, query, r6, rank
from eventlens.bench.views import BenchCorpus
from eventlens.functions.text import map_text
from eventlens.operators import detectors as D
from eventlens.operators import metrics as M


def _conf(impact: str, corr: str, support: str) -> str:
    return f"least(greatest(0.5 + 0.30 / (1 + exp(-5 * (({impact}) - 0.5))) + 0.15 * abs({corr}) + CASE WHEN {support} THEN 0.15 ELSE 0 END, 0), 1)"


def _finding(title, kind, cond, sev, impact_score, corr, support, evidence, reasoning, impact) -> str:
    ev = " || '; ' || ".join(f"'{k}=' || {v}" for k, v in evidence)
    return (f"SELECT app_id, abs({corr}) AS correlation, {support} AS has_evidence, {title} AS bottleneck, '{kind}' AS type, {sev} AS severity, {_conf(impact_score, corr, support)} AS confidence, "
            f"{impact_score} AS impact_score, {ev} AS evidence, {reasoning} AS reasoning, {impact} AS impact FROM m WHERE {cond}")


def _sev(x, crit, high):
    return f"CASE WHEN {x} > {crit} THEN 'CRITICAL' WHEN {x} > {high} THEN 'HIGH' ELSE 'MEDIUM' END"


_IO = "shuffle_ratio > 0.3"
_INT = div("total_shuffle_bytes", "input_bytes + output_bytes")
FINDINGS = {
    "bn_gc_pressure": _finding(
        "'GC Overhead / Memory Pressure'", "MEMORY", "gc_overhead_ratio > 0.1", _sev("gc_overhead_ratio", 0.4, 0.2), "least(gc_overhead_ratio * 2, 1)",
        "spill_vs_gc", "memory_bytes_spilled > 0",
        [("gc_overhead_percentage", pct("gc_overhead_ratio", 2)), ("memory_spilled", fbytes("memory_bytes_spilled")), ("gc_pressure_level", "gc_pressure_level"),
         ("total_gc_time_ms", "total_gc_time_ms"), ("spill_vs_gc", num("abs(spill_vs_gc)", 3)),
         ("correlation_strength", "CASE WHEN abs(spill_vs_gc) > 0.7 THEN 'STRONG' WHEN abs(spill_vs_gc) > 0.4 THEN 'MODERATE' ELSE 'WEAK' END")],
        f"""'Memory pressure detected with ' || lower(gc_pressure_level) || ' GC overhead. GC consumes ' || {pct('gc_overhead_ratio')} || ' of executor runtime. ' ||
        CASE WHEN memory_bytes_spilled > 0 THEN 'Supporting evidence: ' || {fbytes('memory_bytes_spilled')} || ' spilled to disk' ||
        CASE WHEN abs(spill_vs_gc) > 0.5 THEN ' (strong correlation: ' || {num('abs(spill_vs_gc)', 2)} || ')' ELSE '' END ELSE '' END ||
        '. Confidence based on GC impact severity and correlation with memory metrics.'""",
        f"'GC consumes ' || {pct('gc_overhead_ratio')} || ' of executor runtime, causing performance degradation'"),
    "bn_data_skew": _finding(
        "'Data Skew / Partition Imbalance'", "DATA_SKEW", "(task_skew_ratio > 0.3 OR stragglers_percentage > 5)", _sev("task_skew_ratio", 1.0, 0.5),
        "least(task_skew_ratio, 1)", "coefficient_of_variation", "stragglers_percentage > 5",
        [("task_skew_ratio", num("task_skew_ratio", 3)), ("stragglers_count", "stragglers_count"), ("stragglers_percentage", num("stragglers_percentage", 2)),
         ("min_duration_ms", "min_task_duration"), ("median_duration_ms", num("p50", 1)), ("max_duration_ms", "max_task_duration"), ("p99_duration_ms", num("p99", 1))],
        f"""'Data skew causing uneven partition distribution. Task duration variance is ' || {pct('task_skew_ratio')} || ' of mean, ' ||
        {num('stragglers_percentage', 1)} || '% of tasks are stragglers. P99 task is ' || {num('p99 / p50', 1)} || 'x slower than median. Indicates severe partition imbalance requiring repartitioning.'""",
        f"'Task duration variance is ' || {pct('task_skew_ratio')} || ' of mean, with ' || {num('stragglers_percentage', 1)} || '% straggler tasks'"),
    "bn_cpu_underuse": _finding(
        f"'CPU Underutilization / ' || CASE WHEN {_IO} THEN 'I/O Bottleneck' ELSE 'CPU Underutilization' END", "CPU", "cpu_efficiency < 0.75",
        "CASE WHEN cpu_efficiency < 0.4 THEN 'HIGH' ELSE 'MEDIUM' END", "1 - cpu_efficiency", f"CASE WHEN {_IO} THEN shuffle_ratio ELSE cpu_wait_ratio END", _IO,
        [("cpu_utilization_percentage", pct("cpu_efficiency", 2)), ("cpu_wait_percentage", pct("cpu_wait_ratio", 2)), ("shuffle_ratio", num("shuffle_ratio", 3)),
         ("is_io_bottleneck", f"CAST({_IO} AS VARCHAR)"), ("shuffle_correlation", "CASE WHEN shuffle_ratio > 0.5 THEN 'HIGH' WHEN shuffle_ratio > 0.3 THEN 'MODERATE' ELSE 'LOW' END")],
        f"""CASE WHEN {_IO} THEN 'I/O bottleneck' ELSE 'CPU underutilization' END || ' with ' || {pct('(1 - cpu_efficiency)')} || ' CPU idle time. CPU efficiency is ' ||
        {pct('cpu_efficiency')} || CASE WHEN {_IO} THEN ', shuffle operations consume ' || {pct('shuffle_ratio')} || ' of time, indicating network/disk I/O saturation.'
        ELSE '. Low CPU utilization without I/O pressure suggests serialization overhead or insufficient parallelism.' END""",
        f"'CPUs are ' || {pct('(1 - cpu_efficiency)')} || ' idle, indicating ' || CASE WHEN {_IO} THEN 'I/O bottleneck' ELSE 'inefficient resource utilization' END"),
    "bn_memory_spill": _finding(
        "'Memory Spill to Disk'", "MEMORY", "memory_bytes_spilled > 0 AND spill_ratio > 0.05", _sev("spill_ratio", 0.3, 0.1), "least(spill_ratio * 2, 1)", "spill_ratio",
        "disk_bytes_spilled > 0",
        [("memory_spilled", fbytes("memory_bytes_spilled")), ("disk_spilled", fbytes("disk_bytes_spilled")), ("spill_percentage", pct("spill_ratio", 2)),
         ("tasks_with_spill", "tasks_with_spill")],
        f"""'Insufficient executor memory causing data spill. ' || {fbytes('memory_bytes_spilled')} || ' spilled to memory' ||
        CASE WHEN disk_bytes_spilled > 0 THEN ', ' || {fbytes('disk_bytes_spilled')} || ' spilled to disk' ELSE '' END || ' (' || {pct('spill_ratio')} ||
        ' of input data). Indicates memory pressure requiring increased executor memory allocation.'""",
        f"{fbytes('memory_bytes_spilled')} || ' spilled to disk (' || {pct('spill_ratio')} || ' of input data)'"),
    "bn_shuffle": _finding(
        "'Excessive Shuffle Overhead'", "SHUFFLE", "shuffle_ratio > 0.3", _sev("shuffle_ratio", 0.7, 0.5), "least(shuffle_ratio, 1)", _INT, "shuffle_efficiency < 0.5",
        [("shuffle_time_percentage", pct("shuffle_ratio", 2)), ("shuffle_read_bytes", "shuffle_read_bytes"), ("shuffle_write_bytes", "shuffle_write_bytes"),
         ("total_shuffle", fbytes("total_shuffle_bytes")), ("shuffle_efficiency", num("shuffle_efficiency", 3)), ("shuffle_intensity", num(_INT, 3))],
        f"""'Excessive shuffle operations consuming ' || {pct('shuffle_ratio')} || ' of execution time. Shuffle intensity is ' || {num(_INT, 2)} ||
        'x the I/O volume, shuffle efficiency score is ' || {num('shuffle_efficiency', 2)} || '. Indicates need for broadcast joins or repartitioning strategy.'""",
        f"'Shuffle operations consume ' || {pct('shuffle_ratio')} || ' of execution time'"),
    "bn_executor_imbalance": _finding(
        "'Executor Load Imbalance'", "EXECUTOR", "executor_imbalance_ratio > 0.3", "CASE WHEN executor_imbalance_ratio > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END",
        "least(executor_imbalance_ratio, 1)", "load_imbalance_percentage / 100", "load_imbalance_percentage > 30",
        [("executor_imbalance_ratio", num("executor_imbalance_ratio", 3)), ("load_imbalance_percentage", num("load_imbalance_percentage", 2)),
         ("min_tasks", "min_tasks_per_executor"), ("max_tasks", "max_tasks_per_executor"), ("total_executors", "total_executors")],
        f"""'Uneven task distribution across executors. Load variance is ' || {num('executor_imbalance_ratio', 2)} || ', imbalance is ' ||
        {num('load_imbalance_percentage', 1)} || '%. Max loaded executor has ' || max_tasks_per_executor || ' tasks vs min ' || min_tasks_per_executor ||
        '. Suggests data skew or partitioning issues.'""",
        f"'Task distribution variance is ' || {pct('executor_imbalance_ratio')} || ' across executors'"),
}
_UNION = " UNION ALL ".join(FINDINGS.values())
FINDING_CTES = f"""fd AS (SELECT *, CAST({rank('severity')} AS BIGINT) AS sev_rank FROM ({_UNION})),
fr AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY sev_rank, confidence DESC, bottleneck) AS position, count(*) OVER (PARTITION BY app_id) AS total_bottlenecks,
    count(*) FILTER (severity = 'CRITICAL') OVER (PARTITION BY app_id) AS critical_bottlenecks,
    count(*) FILTER (severity = 'HIGH') OVER (PARTITION BY app_id) AS high_bottlenecks FROM fd)"""
_COLS = f"app_id, bottleneck, type, severity, sev_rank, {r6('confidence')} AS confidence, {r6('impact_score')} AS impact_score, evidence, reasoning, impact"


def skewed_executors(c):
    """Task rows whose executors are uneven: one in four apps sends part of its tasks to one executor."""
    return c.tasks.selectExpr("* EXCEPT (executor_id)", "CASE WHEN app_id IN ('app-1', 'app-5') AND task_id % 3 = 0 THEN 'exec-4' ELSE executor_id END AS executor_id")


def metrics(s, d, *groups):
    return M.app_metrics(BenchCorpus(s, d), *groups)


def text(df):
    return df.selectExpr("* EXCEPT (evidence, detector, correlation, has_evidence)", f"{map_text('evidence')} AS evidence")


for _name, _sql in FINDINGS.items():
    if _name != "bn_executor_imbalance":
        register(_name, lambda s, d, n=_name: text(D.bottlenecks(metrics(s, d, *D.needs(n)), n)), query(
            f"SELECT {_COLS} FROM (SELECT *, CAST({rank('severity')} AS BIGINT) AS sev_rank FROM ({_sql}))"))


def _imbalance(s, d):
    c = BenchCorpus(s, d)
    c.__dict__["tasks"] = skewed_executors(c)
    return text(D.bottlenecks(M.app_metrics(c, "executors"), "bn_executor_imbalance"))


# the driver's suppliers load executors evenly, so this query first moves tasks of two applications to one executor
register("bn_executor_imbalance", _imbalance, query(
    f"SELECT {_COLS} FROM (SELECT *, CAST({rank('severity')} AS BIGINT) AS sev_rank FROM ({FINDINGS['bn_executor_imbalance'].replace('FROM m ', 'FROM me2 ')}))",
    """ec2 AS (SELECT app_id, CASE WHEN app_id IN ('app-1', 'app-5') AND task_id % 3 = 0 THEN 'exec-4' ELSE executor_id END AS executor_id, count(*) AS tasks
    FROM tasks GROUP BY 1, 2),
    me2 AS (SELECT app_id, count(*) AS total_executors, min(tasks) AS min_tasks_per_executor, max(tasks) AS max_tasks_per_executor,
    stddev_pop(tasks) / avg(tasks) AS executor_imbalance_ratio, (max(tasks) - min(tasks)) / avg(tasks) * 100 AS load_imbalance_percentage FROM ec2 GROUP BY 1)"""))

register("confidence_score", lambda s, d: D.bottlenecks(metrics(s, d, *D.needs())).select("app_id", "bottleneck", "confidence"), query(
    f"SELECT app_id, bottleneck, {r6('confidence')} AS confidence FROM fd", FINDING_CTES))
register("bn_ranked", lambda s, d: text(D.ranked(D.bottlenecks(metrics(s, d, *D.needs())))), query(
    f"SELECT {_COLS}, position, total_bottlenecks, critical_bottlenecks, high_bottlenecks FROM fr", FINDING_CTES))
ANOMALY_CTE = f"""an AS (SELECT app_id, 'STAGE_FAILURES' AS type, CASE WHEN failure_rate > 0.2 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, failed_stages AS count,
    failure_rate, failed_stages || ' stage(s) failed (' || {pct('failure_rate')} || ' failure rate)' AS description FROM m WHERE failed_stages > 0
    UNION ALL SELECT app_id, 'STAGE_RETRIES', 'MEDIUM', retried_stages, NULL, retried_stages || ' stage(s) were retried' FROM m WHERE retried_stages > 0)"""
_AN = f"SELECT app_id, type, severity, count, {r6('failure_rate')} AS failure_rate, description FROM an"
register("anomaly_stage_failures", lambda s, d: D.anomaly_stage_failures(metrics(s, d, "stages")), query(_AN + " WHERE type = 'STAGE_FAILURES'", ANOMALY_CTE))
register("anomaly_stage_retries", lambda s, d: D.anomaly_stage_retries(metrics(s, d, "stages")), query(_AN + " WHERE type = 'STAGE_RETRIES'", ANOMALY_CTE))
WARNING_CTE = f"""wn AS (SELECT app_id, 'Moderate GC Overhead' AS warning, {pct('gc_overhead_ratio', 2)} AS value FROM m WHERE gc_overhead_ratio > 0.05 AND gc_overhead_ratio <= 0.1
    UNION ALL SELECT app_id, 'Moderate Shuffle Overhead', {pct('shuffle_ratio', 2)} FROM m WHERE shuffle_ratio > 0.2 AND shuffle_ratio <= 0.3
    UNION ALL SELECT app_id, 'Suboptimal CPU Utilization', {pct('cpu_efficiency', 2)} FROM m WHERE cpu_efficiency >= 0.75 AND cpu_efficiency < 0.85)"""
register("warnings", lambda s, d: D.warnings(metrics(s, d, "gc", "shuffle", "cpu")), query("SELECT * FROM wn", WARNING_CTE))
_SIMPLE = f"""sb AS (
    SELECT app_id, 'LOW_CPU_UTILIZATION' AS type, 'HIGH' AS severity, 'CPU utilization is only ' || {pct('cpu_efficiency')} AS description, cpu_efficiency AS metric_value,
      'Increase executor cores or check for I/O bottlenecks' AS recommendation FROM m WHERE cpu_efficiency < 0.5
    UNION ALL SELECT app_id, 'DATA_SKEW', CASE WHEN task_skew_ratio > 1 THEN 'CRITICAL' ELSE 'HIGH' END, 'High task duration variance: ' || {num('task_skew_ratio', 2)},
      task_skew_ratio, 'Repartition data or use salting for skewed keys' FROM m WHERE task_skew_ratio > 0.5
    UNION ALL SELECT app_id, 'EXCESSIVE_SHUFFLE', CASE WHEN shuffle_time_ratio > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END,
      'Shuffle consumes ' || {pct('shuffle_time_ratio')} || ' of execution time', shuffle_time_ratio, 'Use broadcast joins or reduce shuffle partitions'
      FROM m WHERE shuffle_time_ratio > 0.3
    UNION ALL SELECT app_id, 'HIGH_GC_OVERHEAD', CASE WHEN gc_overhead_ratio > 0.4 THEN 'CRITICAL' ELSE 'HIGH' END, 'GC overhead is ' || {pct('gc_overhead_ratio')},
      gc_overhead_ratio, 'Increase executor memory or tune GC settings' FROM m WHERE gc_overhead_ratio > 0.2
    UNION ALL SELECT app_id, 'EXECUTOR_LOSS', 'CRITICAL', 'Executor(s) lost: ' || executors_removed || ' removal(s)', executors_removed,
      'Check executor logs, increase memory, or adjust timeout settings' FROM m WHERE executors_removed > 0
    UNION ALL SELECT app_id, 'STRAGGLER_TASKS', 'MEDIUM', 'Slowest task is ' || {num('max_task_duration / mean_task_duration', 1)} || 'x slower than average',
      max_task_duration / mean_task_duration, 'Investigate data skew or resource contention' FROM m WHERE max_task_duration / mean_task_duration > 5)"""
register("simple_bottlenecks", lambda s, d: D.simple_bottlenecks(metrics(s, d, *D.SIMPLE_NEEDS)), query(
    f"""SELECT app_id, type, severity, description, {r6('metric_value')} AS metric_value, recommendation, CAST({rank('severity')} AS BIGINT) AS sev_rank,
    count(*) OVER (PARTITION BY app_id) AS total_bottlenecks, count(*) FILTER (severity = 'CRITICAL') OVER (PARTITION BY app_id) AS critical_count,
    count(*) FILTER (severity = 'HIGH') OVER (PARTITION BY app_id) AS high_count FROM sb""", _SIMPLE))
register("task_hotspots", lambda s, d: D.task_hotspots(BenchCorpus(s, d).tasks, metrics(s, d, "task", "quantiles")), query(
    f"""SELECT app_id, row_number() OVER (PARTITION BY app_id ORDER BY duration_ms DESC, task_id, stage_id, executor_id, launch_ms) AS rank, task_id, stage_id,
    duration_ms, executor_id, {num('duration_ms / mean_task_duration', 1)} || 'x' AS deviation_from_mean
    FROM tasks JOIN m USING (app_id) WHERE duration_ms > p95 AND p95 > 0 QUALIFY rank <= 10"""))
