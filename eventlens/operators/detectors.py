"""Bottleneck, anomaly and warning detectors over the application metrics.

Every detector is data: a condition, a severity and texts, all as SQL expressions.  One projection
evaluates any set of them, so the metrics are read once however many detectors run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from eventlens.functions.text import (correlation_label, format_bytes, ladder, links, num, percent, ratio, severity_rank,
                                      shuffle_correlation_label, str_map)


def confidence(impact: str, correlation: str, evidence: str) -> str:
    """Base 0.5, a sigmoid of the impact, the correlation and a bonus for supporting evidence, within 0..1."""
    return (f"least(greatest(0.5D + 0.30D / (1D + exp(-5D * (({impact}) - 0.5D))) + 0.15D * abs({correlation}) + IF({evidence}, 0.15D, 0D), 0D), 1D)")


@dataclass(frozen=True)
class Detector:
    title: str
    type: str
    needs: tuple[str, ...]
    condition: str
    severity: str
    impact_score: str
    correlation: str
    support: str
    evidence: dict[str, str]
    reasoning: str
    impact: str

    def struct(self, name: str) -> str:
        return (f"named_struct('sev_rank', {severity_rank('(' + self.severity + ')')}, 'detector', '{name}', 'bottleneck', {self.title}, "
                f"'type', '{self.type}', 'severity', {self.severity}, 'correlation', CAST(abs({self.correlation}) AS DOUBLE), 'has_evidence', {self.support}, "
                f"'confidence', {confidence(self.impact_score, self.correlation, self.support)}, 'impact_score', {self.impact_score}, "
                f"'evidence', {str_map(**self.evidence)}, 'reasoning', {self.reasoning}, 'impact', {self.impact})")


GC, CV, EFF, SH, SPILL, IMB = "gc_overhead_ratio", "task_skew_ratio", "cpu_efficiency", "shuffle_ratio", "spill_ratio", "executor_imbalance_ratio"
_IO = f"{SH} > 0.3D"
_IDLE = percent(f"(1D - {EFF})")
_INTENSITY = ratio("total_shuffle_bytes", "input_bytes + output_bytes")
_SPILL_GC = "abs(spill_vs_gc)"

# Fixed values and texts: conditions, severities, evidence and reasoning of the six detectors
DETECTORS: dict[str, Detector] = {
    "bn_gc_pressure": Detector(
        "'GC Overhead / Memory Pressure'", "MEMORY", ("gc", "spill", "corr"), f"{GC} > 0.1D",
        ladder(GC, [(0.4, "CRITICAL"), (0.2, "HIGH")], "MEDIUM"), f"least({GC} * 2D, 1D)", _SPILL_GC, "memory_bytes_spilled > 0",
        {"gc_overhead_percentage": percent(GC, 2), "memory_spilled": format_bytes("memory_bytes_spilled"), "gc_pressure_level": "gc_pressure_level",
         "total_gc_time_ms": "total_gc_time_ms", "spill_vs_gc": num(_SPILL_GC, 3), "correlation_strength": correlation_label(_SPILL_GC)},
        f"concat('Memory pressure detected with ', lower(gc_pressure_level), ' GC overhead. GC consumes ', {percent(GC)}, ' of executor runtime. ', "
        f"IF(memory_bytes_spilled > 0, concat('Supporting evidence: ', {format_bytes('memory_bytes_spilled')}, ' spilled to disk', "
        f"IF({_SPILL_GC} > 0.5D, concat(' (strong correlation: ', {num(_SPILL_GC, 2)}, ')'), '')), ''), "
        "'. Confidence based on GC impact severity and correlation with memory metrics.')",
        f"concat('GC consumes ', {percent(GC)}, ' of executor runtime, causing performance degradation')"),
    "bn_data_skew": Detector(
        "'Data Skew / Partition Imbalance'", "DATA_SKEW", ("task", "quantiles"), f"{CV} > 0.3D OR stragglers_percentage > 5D",
        ladder(CV, [(1.0, "CRITICAL"), (0.5, "HIGH")], "MEDIUM"), f"least({CV}, 1D)", "coefficient_of_variation", "stragglers_percentage > 5D",
        {"task_skew_ratio": num(CV, 3), "stragglers_count": "stragglers_count", "stragglers_percentage": num("stragglers_percentage", 2),
         "min_duration_ms": "min_task_duration", "median_duration_ms": num("median_task_duration", 1), "max_duration_ms": "max_task_duration",
         "p99_duration_ms": num("p99", 1)},
        f"concat('Data skew causing uneven partition distribution. Task duration variance is ', {percent(CV)}, ' of mean, ', "
        f"{num('stragglers_percentage', 1)}, '% of tasks are stragglers. ', IF(p50 > 0, concat('P99 task is ', {num('try_divide(p99, p50)', 1)}, "
        "'x slower than median. '), ''), 'Indicates severe partition imbalance requiring repartitioning.')",
        f"concat('Task duration variance is ', {percent(CV)}, ' of mean, with ', {num('stragglers_percentage', 1)}, '% straggler tasks')"),
    "bn_cpu_underuse": Detector(
        f"concat('CPU Underutilization / ', IF({_IO}, 'I/O Bottleneck', 'CPU Underutilization'))", "CPU", ("cpu", "shuffle"), f"{EFF} < 0.75D",
        f"IF({EFF} < 0.4D, 'HIGH', 'MEDIUM')", f"1D - {EFF}", f"IF({_IO}, {SH}, cpu_wait_ratio)", _IO,
        {"cpu_utilization_percentage": percent(EFF, 2), "cpu_wait_percentage": percent("cpu_wait_ratio", 2), "shuffle_ratio": num(SH, 3),
         "is_io_bottleneck": _IO, "shuffle_correlation": shuffle_correlation_label(SH)},
        f"concat(IF({_IO}, 'I/O bottleneck', 'CPU underutilization'), ' with ', {_IDLE}, ' CPU idle time. CPU efficiency is ', {percent(EFF)}, "
        f"IF({_IO}, concat(', shuffle operations consume ', {percent(SH)}, ' of time, indicating network/disk I/O saturation.'), "
        "'. Low CPU utilization without I/O pressure suggests serialization overhead or insufficient parallelism.'))",
        f"concat('CPUs are ', {_IDLE}, ' idle, indicating ', IF({_IO}, 'I/O bottleneck', 'inefficient resource utilization'))"),
    "bn_memory_spill": Detector(
        "'Memory Spill to Disk'", "MEMORY", ("spill",), f"memory_bytes_spilled > 0 AND {SPILL} > 0.05D",
        ladder(SPILL, [(0.3, "CRITICAL"), (0.1, "HIGH")], "MEDIUM"), f"least({SPILL} * 2D, 1D)", SPILL, "disk_bytes_spilled > 0",
        {"memory_spilled": format_bytes("memory_bytes_spilled"), "disk_spilled": format_bytes("disk_bytes_spilled"),
         "spill_percentage": percent(SPILL, 2), "tasks_with_spill": "tasks_with_spill"},
        f"concat('Insufficient executor memory causing data spill. ', {format_bytes('memory_bytes_spilled')}, ' spilled to memory', "
        f"IF(disk_bytes_spilled > 0, concat(', ', {format_bytes('disk_bytes_spilled')}, ' spilled to disk'), ''), ' (', {percent(SPILL)}, "
        "' of input data). Indicates memory pressure requiring increased executor memory allocation.')",
        f"concat({format_bytes('memory_bytes_spilled')}, ' spilled to disk (', {percent(SPILL)}, ' of input data)')"),
    "bn_shuffle": Detector(
        "'Excessive Shuffle Overhead'", "SHUFFLE", ("shuffle", "io"), f"{SH} > 0.3D",
        ladder(SH, [(0.7, "CRITICAL"), (0.5, "HIGH")], "MEDIUM"), f"least({SH}, 1D)", _INTENSITY, "shuffle_efficiency < 0.5D",
        {"shuffle_time_percentage": percent(SH, 2), "shuffle_read_bytes": "shuffle_read_bytes", "shuffle_write_bytes": "shuffle_write_bytes",
         "total_shuffle": format_bytes("total_shuffle_bytes"), "shuffle_efficiency": num("shuffle_efficiency", 3), "shuffle_intensity": num(_INTENSITY, 3)},
        f"concat('Excessive shuffle operations consuming ', {percent(SH)}, ' of execution time. Shuffle intensity is ', {num(_INTENSITY, 2)}, "
        f"'x the I/O volume, shuffle efficiency score is ', {num('shuffle_efficiency', 2)}, '. Indicates need for broadcast joins or repartitioning strategy.')",
        f"concat('Shuffle operations consume ', {percent(SH)}, ' of execution time')"),
    "bn_executor_imbalance": Detector(
        "'Executor Load Imbalance'", "EXECUTOR", ("executors",), f"{IMB} > 0.3D", f"IF({IMB} > 0.6D, 'HIGH', 'MEDIUM')", f"least({IMB}, 1D)",
        "load_imbalance_percentage / 100D", "load_imbalance_percentage > 30D",
        {"executor_imbalance_ratio": num(IMB, 3), "load_imbalance_percentage": num("load_imbalance_percentage", 2), "min_tasks": "min_tasks_per_executor",
         "max_tasks": "max_tasks_per_executor", "total_executors": "total_executors"},
        f"concat('Uneven task distribution across executors. Load variance is ', {num(IMB, 2)}, ', imbalance is ', "
        f"{num('load_imbalance_percentage', 1)}, '%. ', IF(total_executors > 0, concat('Max loaded executor has ', max_tasks_per_executor, ' tasks vs min ', "
        "min_tasks_per_executor, '. '), ''), 'Suggests data skew or partitioning issues.')",
        f"concat('Task distribution variance is ', {percent(IMB)}, ' across executors')"),
}

def finding_arrays(metrics: DataFrame, *names: str) -> DataFrame:
    """Adds ``findings`` to the metrics: the findings of the named detectors (default: all six), ordered by
    severity, then confidence.  One projection, so the metrics are read once."""
    found = links(*[(DETECTORS[n].condition, DETECTORS[n].struct(n)) for n in (names or DETECTORS)])
    keyed = f"transform({found}, f -> named_struct('r', f.sev_rank, 'c', -f.confidence, 'b', f.bottleneck, 'f', f))"
    return metrics.selectExpr("*", f"transform(array_sort({keyed}, (x, y) -> CASE WHEN struct(x.r, x.c, x.b) < struct(y.r, y.c, y.b) THEN -1 "
                                   "WHEN struct(x.r, x.c, x.b) > struct(y.r, y.c, y.b) THEN 1 ELSE 0 END), k -> k.f) AS findings")


def bottlenecks(metrics: DataFrame, *names: str) -> DataFrame:
    """One row per finding of the named detectors (default: all six)."""
    found = links(*[(DETECTORS[n].condition, DETECTORS[n].struct(n)) for n in (names or DETECTORS)])
    return metrics.selectExpr("app_id", f"explode({found}) AS f").selectExpr("app_id", "f.*")


def needs(*names: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(g for n in (names or DETECTORS) for g in DETECTORS[n].needs))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings in order of severity, then confidence, with the counts of the application."""
    return findings.selectExpr(
        "*", "row_number() OVER (PARTITION BY app_id ORDER BY sev_rank, confidence DESC, bottleneck) AS position",
        "count(1) OVER (PARTITION BY app_id) AS total_bottlenecks",
        "count_if(severity = 'CRITICAL') OVER (PARTITION BY app_id) AS critical_bottlenecks",
        "count_if(severity = 'HIGH') OVER (PARTITION BY app_id) AS high_bottlenecks")


def _rows(metrics: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return metrics.selectExpr("app_id", f"explode({links(*pairs)}) AS f").selectExpr("app_id", "f.*")


_FAILURES = (
    "failed_stages > 0",
    "named_struct('type', 'STAGE_FAILURES', 'severity', IF(failure_rate > 0.2D, 'CRITICAL', 'HIGH'), 'count', failed_stages, "
    f"'failure_rate', failure_rate, 'description', concat(failed_stages, ' stage(s) failed (', {percent('failure_rate')}, ' failure rate)'))")
_RETRIES = (
    "retried_stages > 0",
    "named_struct('type', 'STAGE_RETRIES', 'severity', 'MEDIUM', 'count', retried_stages, 'failure_rate', CAST(NULL AS DOUBLE), "
    "'description', concat(retried_stages, ' stage(s) were retried'))")


def anomaly_stage_failures(metrics: DataFrame) -> DataFrame:
    return _rows(metrics, _FAILURES)


def anomaly_stage_retries(metrics: DataFrame) -> DataFrame:
    return _rows(metrics, _RETRIES)


def anomalies(metrics: DataFrame) -> DataFrame:
    return _rows(metrics, _FAILURES, _RETRIES)


def warnings(metrics: DataFrame) -> DataFrame:
    """Moderate values just below the detector bounds."""
    def row(text: str, x: str) -> str:
        return f"named_struct('warning', '{text}', 'value', {percent(x, 2)})"

    return _rows(metrics, (f"{GC} > 0.05D AND {GC} <= 0.1D", row("Moderate GC Overhead", GC)),
                 (f"{SH} > 0.2D AND {SH} <= 0.3D", row("Moderate Shuffle Overhead", SH)),
                 (f"{EFF} >= 0.75D AND {EFF} < 0.85D", row("Suboptimal CPU Utilization", EFF)))


def _simple(cond: str, kind: str, severity: str, text: str, value: str, advice: str) -> tuple[str, str]:
    return cond, (f"named_struct('type', '{kind}', 'severity', {severity}, 'description', {text}, 'metric_value', CAST({value} AS DOUBLE), "
                  f"'recommendation', '{advice}')")


_MAX_MEAN = ratio("max_task_duration", "mean_task_duration")
SIMPLE_NEEDS = ("cpu", "task", "shuffle", "gc", "churn")


def simple_bottlenecks(metrics: DataFrame) -> DataFrame:
    """The second, plainer rule set, ordered by severity with counts."""
    found = _rows(
        metrics,
        _simple(f"{EFF} < 0.5D", "LOW_CPU_UTILIZATION", "'HIGH'", f"concat('CPU utilization is only ', {percent(EFF)})", EFF,
                "Increase executor cores or check for I/O bottlenecks"),
        _simple(f"{CV} > 0.5D", "DATA_SKEW", f"IF({CV} > 1D, 'CRITICAL', 'HIGH')", f"concat('High task duration variance: ', {num(CV, 2)})", CV,
                "Repartition data or use salting for skewed keys"),
        _simple("shuffle_time_ratio > 0.3D", "EXCESSIVE_SHUFFLE", "IF(shuffle_time_ratio > 0.5D, 'HIGH', 'MEDIUM')",
                f"concat('Shuffle consumes ', {percent('shuffle_time_ratio')}, ' of execution time')", "shuffle_time_ratio",
                "Use broadcast joins or reduce shuffle partitions"),
        _simple(f"{GC} > 0.2D", "HIGH_GC_OVERHEAD", f"IF({GC} > 0.4D, 'CRITICAL', 'HIGH')", f"concat('GC overhead is ', {percent(GC)})", GC,
                "Increase executor memory or tune GC settings"),
        _simple("has_executor_loss", "EXECUTOR_LOSS", "'CRITICAL'", "concat('Executor(s) lost: ', executors_removed, ' removal(s)')", "executors_removed",
                "Check executor logs, increase memory, or adjust timeout settings"),
        _simple(f"{_MAX_MEAN} > 5D", "STRAGGLER_TASKS", "'MEDIUM'", f"concat('Slowest task is ', {num(_MAX_MEAN, 1)}, 'x slower than average')", _MAX_MEAN,
                "Investigate data skew or resource contention"))
    return found.selectExpr("*", f"{severity_rank('severity')} AS sev_rank").selectExpr(
        "*", "count(1) OVER (PARTITION BY app_id) AS total_bottlenecks", "count_if(severity = 'CRITICAL') OVER (PARTITION BY app_id) AS critical_count",
        "count_if(severity = 'HIGH') OVER (PARTITION BY app_id) AS high_count")


def task_hotspots(tasks: DataFrame, metrics: DataFrame, top: int = 10) -> DataFrame:
    """The ten longest tasks per application among those above its p95.

    The top of each application is taken first: ``row_number <= n`` is pruned inside every map task, so only
    n rows per application and map task are shuffled.  The p95 bound then filters those few rows,
    which gives the same result as filtering first.
    """
    best = tasks.selectExpr(
        "app_id", "task_id", "stage_id", "duration_ms", "executor_id", "launch_ms",
        "row_number() OVER (PARTITION BY app_id ORDER BY duration_ms DESC, task_id, stage_id, executor_id, launch_ms) AS rank").filter(f"rank <= {int(top)}")
    bounds = metrics.select("app_id", "p95", "mean_task_duration")
    return best.join(bounds, "app_id").filter("p95 > 0 AND duration_ms > p95").selectExpr(
        "app_id", "rank", "task_id", "stage_id", "duration_ms", "executor_id",
        f"IF(mean_task_duration > 0, concat({num('try_divide(duration_ms, mean_task_duration)', 1)}, 'x'), 'N/A') AS deviation_from_mean")
