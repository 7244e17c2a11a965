"""Registry of report queries."""

from eventlens.bench.reg_causes import CAUSE_CTES, CAUSE_NEEDS
from eventlens.bench.reg_detectors import FINDING_CTES
from eventlens.bench.reg_failures import FAILURE_CTES
from eventlens.bench.registry import register
from eventlens.bench.sqltext import fbytes, fdur, num, pct, query, r6, rank
from eventlens.bench.views import BenchCorpus
from eventlens.operators import causes as H
from eventlens.operators import detectors as D
from eventlens.operators import failures as G
from eventlens.operators import metrics as M
from eventlens.plans import report as R
from eventlens.plans.corpus import Diagnosis

REPORT_CTES = f"""
hs AS (SELECT m.app_id, greatest(CAST(trunc(100 - coalesce(sum(CASE fr.severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 3 END * fr.confidence), 0)) AS BIGINT), 0) AS health_score,
    count(fr.app_id) AS total_bottlenecks, count(*) FILTER (fr.severity = 'CRITICAL') AS critical_bottlenecks, count(*) FILTER (fr.severity = 'HIGH') AS high_priority_bottlenecks,
    coalesce(string_agg(fr.type || ' [' || fr.severity || ']', ', ' ORDER BY fr.position) FILTER (fr.position <= 3), '') AS primary_concerns
    FROM m LEFT JOIN fr ON fr.app_id = m.app_id GROUP BY 1),
ex AS (SELECT hs.*, CASE WHEN health_score < 40 THEN 'CRITICAL' WHEN health_score < 60 THEN 'POOR' WHEN health_score < 80 THEN 'FAIR' ELSE 'GOOD' END AS health_status,
    critical_bottlenecks > 0 AS requires_immediate_action,
    CAST(CASE WHEN failed_stages > 0 THEN 1 ELSE 0 END + CASE WHEN retried_stages > 0 THEN 1 ELSE 0 END AS BIGINT) AS total_anomalies,
    total_stage_failures + total_task_failures AS total_failures, total_oom_events > 0 AS has_oom_events, total_stage_failures, total_task_failures, total_executor_failures,
    total_oom_events, total_fetch_failures FROM hs JOIN m USING (app_id) JOIN fc USING (app_id))"""


def jq(sql: str, *extra: str) -> str:
    return query(sql, FINDING_CTES, CAUSE_CTES, FAILURE_CTES, REPORT_CTES, *extra)


def metrics(s, d, *groups):
    return M.app_metrics(BenchCorpus(s, d), *groups)


def found(s, d):
    return D.finding_arrays(metrics(s, d, *D.needs()))


def summary(s, d):
    c = BenchCorpus(s, d)
    return R.executive_summary(D.finding_arrays(M.app_metrics(c)), G.failure_counts(c.tasks, c.stages, c.executor_events, c.task_parts))


register("health_score", lambda s, d: R.health_score(found(s, d)), jq("SELECT app_id, health_score FROM ex"))
register("health_status", lambda s, d: R.health(found(s, d)), jq("SELECT app_id, health_score, health_status FROM ex"))
register("primary_concerns", lambda s, d: R.primary_concerns(found(s, d)), jq(
    "SELECT app_id, position - 1 AS position, type || ' [' || severity || ']' AS concern FROM fr WHERE position <= 3"))


def _exec(s, d):
    c = BenchCorpus(s, d)
    base = D.finding_arrays(M.app_metrics(c, *D.needs(), "stages"))
    out = R.executive_summary(base, G.failure_counts(c.tasks, c.stages, c.executor_events, c.task_parts))
    return out.selectExpr("app_id", *[x for x in R.SUMMARY if x != "primary_concerns"], "array_join(primary_concerns, ', ') AS primary_concerns")


register("executive_summary", _exec, jq("SELECT app_id, " + ", ".join(R.SUMMARY) + " FROM ex"))
_ORD = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END"
register("recommendations_ranked", lambda s, d: R.recommendations_ranked(H.all_root_causes(metrics(s, d, *CAUSE_NEEDS))), jq(
    f"""SELECT app_id, root_cause, severity, {r6('confidence')} AS confidence, recommendation,
    row_number() OVER (PARTITION BY app_id ORDER BY {_ORD}, confidence DESC, root_cause) AS position FROM rca WHERE coalesce(severity, '') <> 'INFO'"""))
register("action_items", lambda s, d: R.action_items(H.root_causes(metrics(s, d, *CAUSE_NEEDS))), jq(
    f"""SELECT app_id, severity, CAST({rank('severity')} AS BIGINT) AS sev_rank, root_cause, i - 1 AS position, action_items[i] AS action
    FROM (SELECT *, unnest(range(1, len(action_items) + 1)) AS i FROM rcx)"""))
KPI = [("CPU Efficiency", pct("cpu_efficiency", 2), "CASE WHEN cpu_efficiency > 0.8 THEN 'Good' WHEN cpu_efficiency > 0.6 THEN 'Fair' ELSE 'Poor' END"),
       ("GC Overhead", pct("gc_overhead_ratio", 2), "CASE gc_pressure_level WHEN 'LOW' THEN 'Good' WHEN 'MEDIUM' THEN 'Fair' ELSE 'Poor' END"),
       ("Shuffle Efficiency", num("shuffle_efficiency", 3), "CASE WHEN shuffle_efficiency > 0.7 THEN 'Good' WHEN shuffle_efficiency > 0.5 THEN 'Fair' ELSE 'Poor' END"),
       ("Memory Spilled", fbytes("memory_bytes_spilled"), "CASE WHEN memory_bytes_spilled = 0 THEN 'None' WHEN memory_bytes_spilled < 1000000000 THEN 'Moderate' ELSE 'High' END")]
register("kpi_table", lambda s, d: R.kpi_table(metrics(s, d, "cpu", "gc", "shuffle", "spill")), jq(
    " UNION ALL ".join(f"SELECT app_id, CAST({i} AS BIGINT) AS position, '{n}' AS kpi, {v} AS value, {st} AS status FROM m" for i, (n, v, st) in enumerate(KPI))))


def _q(k: str) -> str:
    return f"'\"{k}\":'"


def _str(k, x):
    return f"{_q(k)} || '\"' || {x} || '\"'"


def _raw(k, x):
    return f"{_q(k)} || CAST({x} AS VARCHAR)"


def _dec(k, x, n):
    return f"{_q(k)} || {num(f'round(CAST({x} AS DOUBLE), {n})', n)}"


def _obj(*parts):
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _nest(k, x):
    return f"{_q(k)} || {x}"


_SUMMARY_JSON = _obj(_raw("health_score", "ex.health_score"), _str("health_status", "health_status"), _raw("total_bottlenecks", "total_bottlenecks"),
                     _raw("critical_bottlenecks", "critical_bottlenecks"), _raw("high_priority_bottlenecks", "high_priority_bottlenecks"), _raw("total_anomalies", "total_anomalies"),
                     _raw("requires_immediate_action", "requires_immediate_action"),
                     _nest("primary_concerns", "'[' || CASE WHEN primary_concerns = '' THEN '' ELSE '\"' || replace(primary_concerns, ', ', '\",\"') || '\"' END || ']'"),
                     _raw("total_failures", "total_failures"), _raw("has_oom_events", "has_oom_events"))
_PERF_JSON = _obj(
    _nest("global", _obj(_raw("total_jobs", "total_jobs"), _raw("total_stages", "total_stages"), _raw("total_tasks", "total_tasks"),
                         _str("application_duration", fdur("application_duration_ms", True)), _raw("application_duration_ms", "application_duration_ms"))),
    _nest("task_metrics", _obj(_raw("total_tasks", "total_tasks"), _dec("mean_duration_ms", "mean_task_duration", 2), _dec("median_duration_ms", "p50", 2), _dec("std_duration_ms", "std_task_duration", 2),
                               _dec("skew_ratio", "task_skew_ratio", 3), _nest("percentiles", _obj(*[_dec(p, p, 2) for p in ("p25", "p50", "p75", "p90", "p95", "p99")])),
                               _nest("stragglers", _obj(_raw("count", "stragglers_count"), _dec("percentage", "stragglers_percentage", 2))))),
    _nest("cpu_metrics", _obj(_dec("efficiency", "cpu_efficiency", 3), _str("efficiency_percentage", pct("cpu_efficiency", 2)), _str("wait_percentage", pct("cpu_wait_ratio", 2)),
                              _str("deserialize_overhead_percentage", num("deserialize_overhead_percentage", 2) + " || '%'"))),
    _nest("memory_metrics", _obj(_dec("gc_overhead_ratio", "gc_overhead_ratio", 3), _str("gc_overhead_percentage", pct("gc_overhead_ratio", 2)), _str("gc_pressure_level", "gc_pressure_level"),
                                 _raw("memory_bytes_spilled", "memory_bytes_spilled"), _str("memory_spilled_formatted", fbytes("memory_bytes_spilled")), _raw("disk_bytes_spilled", "disk_bytes_spilled"),
                                 _str("total_spilled_formatted", fbytes("total_spilled")), _raw("tasks_with_spill", "tasks_with_spill"))),
    _nest("io_metrics", _obj(_raw("input_bytes", "input_bytes"), _str("input_formatted", fbytes("input_bytes")), _raw("output_bytes", "output_bytes"), _str("output_formatted", fbytes("output_bytes")),
                             _raw("input_records", "input_records"))),
    _nest("shuffle_metrics", _obj(_raw("shuffle_read_bytes", "shuffle_read_bytes"), _raw("shuffle_write_bytes", "shuffle_write_bytes"), _str("total_shuffle_formatted", fbytes("total_shuffle_bytes")),
                                  _raw("shuffle_time_ms", "shuffle_time_ms"), _dec("shuffle_ratio", "shuffle_ratio", 3), _dec("shuffle_efficiency", "shuffle_efficiency", 3))),
    _nest("executor_metrics", _obj(_raw("total_executors", "total_executors"), _dec("imbalance_ratio", "executor_imbalance_ratio", 3), _dec("load_imbalance_percentage", "load_imbalance_percentage", 2),
                                   _raw("min_tasks_per_executor", "min_tasks_per_executor"), _raw("max_tasks_per_executor", "max_tasks_per_executor"), _dec("mean_tasks_per_executor", "mean_tasks_per_executor", 2))),
    _nest("correlations", _obj(_dec("gc_vs_duration", "gc_vs_duration", 3), _dec("spill_vs_gc", "spill_vs_gc", 3), _dec("shuffle_vs_duration", "shuffle_vs_duration", 3))))
_BN_JSON = _obj(_str("bottleneck", "bottleneck"), _str("type", "type"), _str("severity", "severity"), _dec("confidence", "confidence", 3), _str("impact", "impact"))
_FAIL_JSON = _obj(*[_raw(k, k) for k in ("total_stage_failures", "total_task_failures", "total_executor_failures", "total_oom_events", "total_fetch_failures")])
_DOC = _obj(_str("report_version", "'2.0'"), _str("app_id", "app_id"), _nest("executive_summary", _SUMMARY_JSON), _nest("performance_metrics", _PERF_JSON),
            _nest("bottlenecks", "coalesce(bj, '[]')"), _nest("failures", _FAIL_JSON))
DOC_SQL = jq(f"SELECT app_id, {_DOC} AS document FROM ex JOIN m USING (app_id) LEFT JOIN bj USING (app_id)",
             f"bj AS (SELECT app_id, '[' || string_agg({_BN_JSON}, ',' ORDER BY position) || ']' AS bj FROM fr GROUP BY 1)")
register("report_document", lambda s, d: R.report_document(summary(s, d)), DOC_SQL)


def _lines(s, d):
    return Diagnosis(BenchCorpus(s, d)).report_lines()


register("report_lines", _lines)
register("report_summary_lines", lambda s, d: R.text_summary_lines(summary(s, d)))


def _stage_job(s, d):
    return Diagnosis(BenchCorpus(s, d)).stage_job_report()


register("stage_job_report", _stage_job)


def _dash(s, d):
    c = BenchCorpus(s, d)
    return R.dashboard_feed(D.finding_arrays(M.app_metrics(c, *D.needs())), M.executor_task_counts(c.tasks))


_GB = 1024**3
_UP = "CASE WHEN {0} * 100 < 40 THEN 'critical' WHEN {0} * 100 < 70 THEN 'medium' ELSE 'low' END"
register("dashboard_feed", _dash, jq(f"""
    SELECT app_id, 'gauge' AS panel, CAST(0 AS BIGINT) AS position, 'CPU Efficiency' AS label, {r6('cpu_efficiency * 100')} AS value, {_UP.format('cpu_efficiency')} AS band FROM m
    UNION ALL SELECT app_id, 'gauge', 0, 'GC Overhead', {r6('gc_overhead_ratio * 100')}, CASE WHEN gc_overhead_ratio * 100 < 30 THEN 'low' WHEN gc_overhead_ratio * 100 < 50 THEN 'medium' ELSE 'critical' END FROM m
    UNION ALL SELECT app_id, 'gauge', 0, 'Shuffle Efficiency', {r6('shuffle_efficiency * 100')}, {_UP.format('shuffle_efficiency')} FROM m
    UNION ALL """ + " UNION ALL ".join(f"SELECT app_id, 'percentiles', {i}, '{p.upper()}', {r6(p)}, 'normal' FROM m" for i, p in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))) + f"""
    UNION ALL SELECT app_id, 'spill_gb', 0, 'Memory', {r6(f'memory_bytes_spilled / {_GB}')}, 'high' FROM m WHERE total_spilled > 0
    UNION ALL SELECT app_id, 'spill_gb', 1, 'Disk', {r6(f'disk_bytes_spilled / {_GB}')}, 'critical' FROM m WHERE total_spilled > 0
    UNION ALL SELECT app_id, 'bottlenecks', position - 1, bottleneck || ' [' || severity || ']', {r6('confidence * 100')}, lower(severity) FROM fr WHERE position <= 5
    UNION ALL SELECT app_id, 'executor_load', row_number() OVER (PARTITION BY app_id ORDER BY tasks DESC, executor_id) - 1 AS p, executor_id, CAST(tasks AS DOUBLE), 'normal' FROM mec QUALIFY p < 10"""))
