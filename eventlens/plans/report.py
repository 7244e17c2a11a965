"""Report tables: health, concerns, indicators, documents and text lines.

All work on ``metrics`` with a ``findings`` array per application (``detectors.finding_arrays``), i.e. on one row
per application; only the rendered lines are longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import format_bytes, format_duration, links, map_text, num, percent, severity_rank

# Points taken off the health score per severity
WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8}
OTHER_WEIGHT = 3

SCORE = ("greatest(CAST(100D - aggregate(findings, 0D, (acc, f) -> acc + CASE f.severity "
         + " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
         + f" ELSE {OTHER_WEIGHT} END * coalesce(f.confidence, 1D)) AS INT), 0)")


def health_status(score: str) -> str:
    return f"CASE WHEN {score} < 40 THEN 'CRITICAL' WHEN {score} < 60 THEN 'POOR' WHEN {score} < 80 THEN 'FAIR' ELSE 'GOOD' END"


CONCERNS = "transform(slice(findings, 1, 3), f -> concat(f.type, ' [', f.severity, ']'))"
ANOMALIES = "IF(failed_stages > 0, 1, 0) + IF(retried_stages > 0, 1, 0)"


def _count(severity: str) -> str:
    return f"size(filter(findings, f -> f.severity = '{severity}'))"


def health_score(found: DataFrame) -> DataFrame:
    return found.selectExpr("app_id", f"{SCORE} AS health_score")


def health(found: DataFrame) -> DataFrame:
    return health_score(found).selectExpr("app_id", "health_score", f"{health_status('health_score')} AS health_status")


def primary_concerns(found: DataFrame) -> DataFrame:
    """(app_id, position, concern): at most three per application."""
    return found.selectExpr("app_id", f"posexplode({CONCERNS}) AS (position, concern)")


def executive_summary(found: DataFrame, failure_counts: DataFrame) -> DataFrame:
    fails = failure_counts.selectExpr("app_id", "total_stage_failures + total_task_failures AS total_failures", "total_oom_events > 0 AS has_oom_events",
                                      "total_stage_failures", "total_task_failures", "total_executor_failures", "total_oom_events", "total_fetch_failures")
    return found.join(fails, "app_id", "left").selectExpr("*", f"{SCORE} AS health_score").selectExpr(
        "*", f"{health_status('health_score')} AS health_status", "size(findings) AS total_bottlenecks", f"{_count('CRITICAL')} AS critical_bottlenecks",
        f"{_count('HIGH')} AS high_priority_bottlenecks", f"{ANOMALIES} AS total_anomalies", f"{_count('CRITICAL')} > 0 AS requires_immediate_action",
        f"{CONCERNS} AS primary_concerns")


SUMMARY = ("health_score", "health_status", "total_bottlenecks", "critical_bottlenecks", "high_priority_bottlenecks", "total_anomalies",
           "requires_immediate_action", "primary_concerns", "total_failures", "has_oom_events")


def recommendations_ranked(causes: DataFrame) -> DataFrame:
    """Recommendations of real causes in order of severity, then confidence."""
    order = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END"
    return causes.filter("coalesce(severity, '') <> 'INFO' AND length(recommendation) > 0").selectExpr(
        "app_id", "root_cause", "severity", "confidence", "recommendation",
        f"row_number() OVER (PARTITION BY app_id ORDER BY {order}, confidence DESC, root_cause) AS position")


def action_items(causes: DataFrame) -> DataFrame:
    return causes.selectExpr("app_id", "severity", f"{severity_rank('severity')} AS sev_rank", "root_cause", "posexplode(action_items) AS (position, action)")


KPIS = (
    ("CPU Efficiency", percent("cpu_efficiency", 2), "CASE WHEN cpu_efficiency > 0.8D THEN 'Good' WHEN cpu_efficiency > 0.6D THEN 'Fair' ELSE 'Poor' END"),
    ("GC Overhead", percent("gc_overhead_ratio", 2), "CASE gc_pressure_level WHEN 'LOW' THEN 'Good' WHEN 'MEDIUM' THEN 'Fair' ELSE 'Poor' END"),
    ("Shuffle Efficiency", num("shuffle_efficiency", 3), "CASE WHEN shuffle_efficiency > 0.7D THEN 'Good' WHEN shuffle_efficiency > 0.5D THEN 'Fair' ELSE 'Poor' END"),
    ("Memory Spilled", format_bytes("memory_bytes_spilled"), "CASE WHEN memory_bytes_spilled = 0 THEN 'None' WHEN memory_bytes_spilled < 1000000000 THEN 'Moderate' ELSE 'High' END"),
)


def kpi_table(metrics: DataFrame) -> DataFrame:
    rows = ", ".join(f"{i}, '{n}', {v}, {s}" for i, (n, v, s) in enumerate(KPIS))
    return metrics.selectExpr("app_id", f"stack({len(KPIS)}, {rows}) AS (position, kpi, value, status)")


def _dec(x: str, digits: int) -> str:
    """A rounded number that JSON prints plainly."""
    return f"CAST(round({x}, {digits}) AS DECIMAL(24, {digits}))"


_DOCUMENT = f"""named_struct(
  'report_version', '2.0', 'app_id', app_id,
  'executive_summary', named_struct({", ".join(f"'{c}', {c}" for c in SUMMARY)}),
  'performance_metrics', named_struct(
    'global', named_struct('total_jobs', total_jobs, 'total_stages', total_stages, 'total_tasks', total_tasks,
      'application_duration', {format_duration('application_duration_ms', True)}, 'application_duration_ms', application_duration_ms),
    'task_metrics', named_struct('total_tasks', total_tasks, 'mean_duration_ms', {_dec('mean_task_duration', 2)}, 'median_duration_ms', {_dec('median_task_duration', 2)},
      'std_duration_ms', {_dec('std_task_duration', 2)}, 'skew_ratio', {_dec('task_skew_ratio', 3)},
      'percentiles', named_struct({", ".join(f"'{p}', {_dec(p, 2)}" for p in ("p25", "p50", "p75", "p90", "p95", "p99"))}),
      'stragglers', named_struct('count', stragglers_count, 'percentage', {_dec('stragglers_percentage', 2)})),
    'cpu_metrics', named_struct('efficiency', {_dec('cpu_efficiency', 3)}, 'efficiency_percentage', {percent('cpu_efficiency', 2)},
      'wait_percentage', {percent('cpu_wait_ratio', 2)}, 'deserialize_overhead_percentage', concat({num('deserialize_overhead_percentage', 2)}, '%')),
    'memory_metrics', named_struct('gc_overhead_ratio', {_dec('gc_overhead_ratio', 3)}, 'gc_overhead_percentage', {percent('gc_overhead_ratio', 2)},
      'gc_pressure_level', gc_pressure_level, 'memory_bytes_spilled', memory_bytes_spilled, 'memory_spilled_formatted', {format_bytes('memory_bytes_spilled')},
      'disk_bytes_spilled', disk_bytes_spilled, 'total_spilled_formatted', {format_bytes('total_spilled')}, 'tasks_with_spill', tasks_with_spill),
    'io_metrics', named_struct('input_bytes', input_bytes, 'input_formatted', {format_bytes('input_bytes')}, 'output_bytes', output_bytes,
      'output_formatted', {format_bytes('output_bytes')}, 'input_records', input_records),
    'shuffle_metrics', named_struct('shuffle_read_bytes', shuffle_read_bytes, 'shuffle_write_bytes', shuffle_write_bytes,
      'total_shuffle_formatted', {format_bytes('total_shuffle_bytes')}, 'shuffle_time_ms', shuffle_time_ms, 'shuffle_ratio', {_dec('shuffle_ratio', 3)},
      'shuffle_efficiency', {_dec('shuffle_efficiency', 3)}),
    'executor_metrics', named_struct('total_executors', total_executors, 'imbalance_ratio', {_dec('executor_imbalance_ratio', 3)},
      'load_imbalance_percentage', {_dec('load_imbalance_percentage', 2)}, 'min_tasks_per_executor', min_tasks_per_executor,
      'max_tasks_per_executor', max_tasks_per_executor, 'mean_tasks_per_executor', {_dec('mean_tasks_per_executor', 2)}),
    'correlations', named_struct('gc_vs_duration', {_dec('gc_vs_duration', 3)}, 'spill_vs_gc', {_dec('spill_vs_gc', 3)},
      'shuffle_vs_duration', {_dec('shuffle_vs_duration', 3)})),
  'bottlenecks', transform(findings, f -> named_struct('bottleneck', f.bottleneck, 'type', f.type, 'severity', f.severity, 'confidence', {_dec('f.confidence', 3)},
    'impact', f.impact)),
  'failures', named_struct('total_stage_failures', total_stage_failures, 'total_task_failures', total_task_failures, 'total_executor_failures', total_executor_failures,
    'total_oom_events', total_oom_events, 'total_fetch_failures', total_fetch_failures))"""


def report_document(summary: DataFrame) -> DataFrame:
    """(app_id, document): the report of each application as one JSON text.

    Lists in it are bounded (six findings at most); long lists such as failures stay in their own tables.
    """
    return summary.selectExpr("app_id", f"to_json({_DOCUMENT}) AS document")


RULE = "repeat('=', 80)"
DASH = "repeat('-', 80)"


def _lines(df: DataFrame, section: int, name: str, lines: str, before: str = "0") -> DataFrame:
    return df.selectExpr("app_id", f"{section} AS section_no", f"'{name}' AS section", f"CAST({before} AS BIGINT) AS item_no",
                         f"posexplode(filter({lines}, l -> l IS NOT NULL)) AS (line_no, line)")


def report_lines(summary: DataFrame, causes: DataFrame) -> DataFrame:
    """The readable report as rows (app_id, section_no, section, item_no, line_no, line); sorted by them it is the text."""
    head = _lines(summary, 0, "summary", f"""array('# Spark Event Log Analysis Report', '', '## Executive Summary', '',
        concat('### Application Health: **', health_status, '** (', health_score, '/100)'), '',
        IF(requires_immediate_action, '**IMMEDIATE ACTION REQUIRED** - Critical issues detected', NULL),
        concat('- **Total Bottlenecks:** ', total_bottlenecks), concat('- **Critical Issues:** ', critical_bottlenecks),
        concat('- **High Priority Issues:** ', high_priority_bottlenecks), concat('- **Anomalies Detected:** ', total_anomalies),
        IF(size(primary_concerns) > 0, concat('- **Primary Concerns:** ', array_join(primary_concerns, ', ')), NULL))""")
    overview = _lines(summary, 1, "overview", f"""array('### Application Overview', '| Metric | Value |', '|--------|-------|',
        concat('| Total Jobs | ', total_jobs, ' |'), concat('| Total Stages | ', total_stages, ' |'), concat('| Total Tasks | ', total_tasks, ' |'),
        concat('| Total Duration | ', {format_duration('application_duration_ms', True)}, ' |'))""")
    kpi_rows = ", ".join(f"concat('| {n} | ', {v}, ' | ', {s}, ' |')" for n, v, s in KPIS)
    kpis = _lines(summary, 2, "kpis", f"array('### Key Performance Indicators', '| KPI | Value | Status |', '|-----|-------|--------|', {kpi_rows})")
    found = summary.selectExpr("app_id", "posexplode(findings) AS (n, f)")
    bottle = _lines(found, 3, "bottlenecks", f"""array(concat('### ', n + 1, '. ', f.type), concat('**Severity:** ', f.severity),
        concat('**Confidence:** ', {num('f.confidence * 100D', 0)}, '%'), concat('**Impact:** ', f.impact), concat('**Analysis:** ', f.reasoning),
        concat('**Evidence:** ', {map_text('f.evidence')}))""", "n")
    real = causes.filter("coalesce(severity, '') <> 'INFO'").selectExpr(
        "*", f"row_number() OVER (PARTITION BY app_id ORDER BY {severity_rank('severity')}, confidence DESC, root_cause) AS n")
    cause = _lines(real, 4, "root_causes", f"""array(concat('### ', n, '. ', root_cause), concat('**Severity:** ', coalesce(severity, 'UNKNOWN')),
        concat('**Confidence:** ', {num('confidence * 100D', 0)}, '%'), concat('**Recommendation:** ', recommendation),
        concat('**Supporting Metrics:** ', {map_text('supporting_metrics')}))""", "n")
    acts = _lines(real.filter("size(action_items) > 0"), 5, "actions", "transform(action_items, a -> concat('- **', root_cause, ':** ', a))", "n")
    fails = _lines(summary.filter("total_oom_events > 0 OR total_stage_failures > 0"), 6, "failures", """array('## Failure Analysis',
        concat('- **Stage Failures:** ', total_stage_failures), concat('- **Task Failures:** ', total_task_failures),
        concat('- **Executor Failures:** ', total_executor_failures), concat('- **OOM Events:** ', total_oom_events), concat('- **Fetch Failures:** ', total_fetch_failures))""")
    return reduce(DataFrame.unionByName, [head, overview, kpis, bottle, cause, acts, fails])


def text_summary_lines(summary: DataFrame) -> DataFrame:
    """The short plain-text report, one row per line."""
    shown = (f"flatten(transform(findings, (f, i) -> array(concat(i + 1, '. ', f.type, ' [', f.severity, '] - Confidence: ', {num('f.confidence * 100D', 0)}, '%'), "
             "concat('   Impact: ', f.impact), concat('   ', left(f.reasoning, 200), '...'), '')))")
    body = f"""concat(array({RULE}, 'COMPREHENSIVE PERFORMANCE REPORT', {RULE}, '', 'EXECUTIVE SUMMARY', {DASH},
        concat('Health Status: ', health_status, ' (', health_score, '/100)'), concat('Total Bottlenecks: ', total_bottlenecks),
        concat('Critical Issues: ', critical_bottlenecks), concat('High Priority Issues: ', high_priority_bottlenecks),
        IF(requires_immediate_action, '*** IMMEDIATE ACTION REQUIRED ***', NULL), 'APPLICATION OVERVIEW', {DASH}, concat('Total Jobs: ', total_jobs),
        concat('Total Stages: ', total_stages), concat('Total Tasks: ', total_tasks), concat('Total Duration: ', {format_duration('application_duration_ms', True)}),
        'KEY PERFORMANCE INDICATORS', {DASH}, concat('CPU Efficiency: ', {percent('cpu_efficiency', 2)}),
        concat('GC Overhead: ', {percent('gc_overhead_ratio', 2)}, ' (', gc_pressure_level, ')'), concat('Shuffle Efficiency: ', {num('shuffle_efficiency', 3)}),
        concat('Memory Spilled: ', {format_bytes('memory_bytes_spilled')})),
        IF(size(findings) > 0, array(concat('IDENTIFIED BOTTLENECKS (', size(findings), ')'), {DASH}), CAST(array() AS ARRAY<STRING>)), {shown}, array({RULE}))"""
    return _lines(summary, 0, "summary", body)


def stage_job_report(stage_summary: DataFrame, job_summary: DataFrame, problems: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Stage and job report as ordered lines, with the table of the ten hottest stages."""
    stages = _lines(stage_summary, 0, "stages", """array('## Stage Summary', concat('- **Total Stages:** ', total_stages), concat('- **Failed Stages:** ', failed_stages),
        concat('- **Stages with Issues:** ', stages_with_issues), concat('- **Total Duration:** ', total_duration_formatted))""")
    jobs = _lines(job_summary, 1, "jobs", """array('## Job Summary', concat('- **Total Jobs:** ', total_jobs), concat('- **Failed Jobs:** ', failed_jobs),
        concat('- **Successful Jobs:** ', successful_jobs))""")
    bad = _lines(problems, 2, "transformations", """concat(array(concat('### Stage ', stage_id, ': ', stage_name),
        concat('- **Transformation:** ', transformation_type, ' (', operation, ')'), concat('- **Severity:** ', severity), '- **Issues:**'),
        transform(issues, i -> concat('  - ', i.description)))""", "stage_id")
    hot = _lines(hotspots, 3, "hotspots", """array(concat('| ', rank, ' | ', stage_id, ' | ', duration_formatted, ' | ', task_count, ' | ', transformation_type, ' | ',
        issue_count, ' |'))""", "rank")
    return reduce(DataFrame.unionByName, [stages, jobs, bad, hot])


def _gauge(label: str, x: str, bands: str) -> str:
    return f"named_struct('panel', 'gauge', 'position', 0, 'label', '{label}', 'value', {x} * 100D, 'band', {bands})"


def _up(x: str) -> str:
    return f"CASE WHEN {x} * 100D < 40 THEN 'critical' WHEN {x} * 100D < 70 THEN 'medium' ELSE 'low' END"


_GIB = 1024**3


def dashboard_feed(found: DataFrame, executor_counts: DataFrame) -> DataFrame:
    """(app_id, panel, position, label, value, band): gauges, top bottlenecks, percentiles, spill and executor load."""
    fixed = [
        ("true", _gauge("CPU Efficiency", "cpu_efficiency", _up("cpu_efficiency"))),
        ("true", _gauge("GC Overhead", "gc_overhead_ratio", "CASE WHEN gc_overhead_ratio * 100D < 30 THEN 'low' WHEN gc_overhead_ratio * 100D < 50 THEN 'medium' ELSE 'critical' END")),
        ("true", _gauge("Shuffle Efficiency", "shuffle_efficiency", _up("shuffle_efficiency"))),
        *[("true", f"named_struct('panel', 'percentiles', 'position', {i}, 'label', '{p.upper()}', 'value', CAST({p} AS DOUBLE), 'band', 'normal')")
          for i, p in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))],
        ("total_spilled > 0", f"named_struct('panel', 'spill_gb', 'position', 0, 'label', 'Memory', 'value', memory_bytes_spilled / {_GIB}D, 'band', 'high')"),
        ("total_spilled > 0", f"named_struct('panel', 'spill_gb', 'position', 1, 'label', 'Disk', 'value', disk_bytes_spilled / {_GIB}D, 'band', 'critical')"),
    ]
    top = ("transform(slice(findings, 1, 5), (f, i) -> named_struct('panel', 'bottlenecks', 'position', i, 'label', concat(f.bottleneck, ' [', f.severity, ']'), "
           "'value', f.confidence * 100D, 'band', lower(f.severity)))")
    rows = found.selectExpr("app_id", f"explode(concat({links(*fixed)}, {top})) AS r").selectExpr("app_id", "r.*")
    load = executor_counts.selectExpr(
        "app_id", "'executor_load' AS panel", "row_number() OVER (PARTITION BY app_id ORDER BY tasks DESC, executor_id) AS position",
        "executor_id AS label", "CAST(tasks AS DOUBLE) AS value", "'normal' AS band").filter("position <= 10").withColumn("position", F.expr("position - 1"))  # the limit is met before the shuffle
    return rows.unionByName(load)
