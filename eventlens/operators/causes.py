"""Root causes of findings and cause chains of stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.text import (format_bytes, format_duration, is_executor_failure, links, lit, num, percent, ratio, severity_rank, str_map)
from eventlens.operators.detectors import DETECTORS

GC, SH, SK, EFF, IMB, SPILL = ("gc_overhead_ratio", "shuffle_ratio", "task_skew_ratio", "cpu_efficiency", "executor_imbalance_ratio", "spill_ratio")
_SPREAD = "CASE WHEN min_task_duration > 0 THEN max_task_duration / min_task_duration ELSE CAST('Infinity' AS DOUBLE) END"
_SHUFFLED = "shuffle_read_bytes + shuffle_write_bytes"

# Fixed texts: recommendation ladders of the six kinds -------------------------
RECOMMENDATIONS = {
    "bn_gc_pressure":
        f"CASE WHEN {GC} > 0.4D THEN concat('CRITICAL: GC overhead is ', {percent(GC)}, ', severely impacting performance. Immediately increase executor memory by at least 50% and enable G1GC.') "
        f"WHEN {GC} > 0.2D THEN concat('HIGH: GC overhead is ', {percent(GC)}, '. Increase executor memory by 20-30% and tune GC settings. Consider reviewing caching strategy.') "
        f"ELSE concat('Moderate GC overhead detected (', {percent(GC)}, '). Monitor and increase memory if it worsens.') END",
    "bn_shuffle":
        f"CASE WHEN {SH} > 0.7D THEN concat('CRITICAL: Shuffle operations consume ', {percent(SH)}, ' of execution time (', {format_bytes(_SHUFFLED)}, ' shuffled). Enable AQE and optimize join strategy immediately.') "
        f"WHEN {SH} > 0.5D THEN concat('HIGH: Excessive shuffle overhead (', {percent(SH)}, ' of time, ', {format_bytes(_SHUFFLED)}, ' data). Enable broadcast joins and AQE.') "
        "ELSE 'Moderate shuffle detected. Consider optimizing if shuffle grows.' END",
    "bn_data_skew":
        f"CASE WHEN {SK} > 1.0D OR {_SPREAD} > 10D THEN concat('CRITICAL: Severe data skew detected. Slowest task is ', IF(min_task_duration > 0, {num('try_divide(max_task_duration, min_task_duration)', 1)}, 'inf'), 'x slower than fastest. Enable skew join optimization and use salting technique.') "
        f"WHEN {SK} > 0.5D THEN concat('HIGH: Significant data skew (variance ', {num(SK, 2)}, '). Enable AQE skew handling and repartition data.') "
        "ELSE 'Moderate skew detected. Monitor partition sizes.' END",
    "bn_cpu_underuse":
        f"CASE WHEN {EFF} < 0.4D THEN concat('CRITICAL: CPUs are ', {percent(f'(1D - {EFF})')}, ' idle. Likely I/O bound or severe serialization overhead. Investigate disk/network bottlenecks immediately.') "
        f"WHEN {EFF} < 0.6D THEN concat('HIGH: CPU utilization is only ', {percent(EFF)}, '. Increase parallelism and check for I/O bottlenecks.') "
        f"ELSE concat('Suboptimal CPU usage (', {percent(EFF)}, '). Consider increasing cores per executor.') END",
    "bn_executor_imbalance":
        f"CASE WHEN {IMB} > 0.6D THEN concat('CRITICAL: Severe load imbalance. Max executor has ', max_tasks_per_executor, ' tasks vs min ', min_tasks_per_executor, '. Repartition data immediately and check for skewed keys.') "
        f"WHEN {IMB} > 0.4D THEN concat('HIGH: Significant load imbalance (ratio ', {num(IMB, 2)}, '). Review partitioning strategy and enable dynamic allocation.') "
        "ELSE 'Moderate imbalance detected. Monitor executor utilization.' END",
    "bn_memory_spill":
        f"CASE WHEN {SPILL} > 0.3D THEN concat('CRITICAL: ', {format_bytes('memory_bytes_spilled')}, ' spilled to disk (', {percent(SPILL)}, ' of data). Increase executor memory by at least 50% immediately.') "
        f"WHEN {SPILL} > 0.1D THEN concat('HIGH: ', {format_bytes('memory_bytes_spilled')}, ' spilled. Increase executor memory by 20-30%.') "
        f"ELSE concat('Memory spill detected (', {format_bytes('memory_bytes_spilled')}, '). Monitor and adjust if needed.') END",
}


@dataclass(frozen=True)
class Cause:
    name: str
    supporting: dict[str, str]
    actions: tuple[str, ...]
    first_action: str | None = None  # expression, when the first action quotes a figure


# Fixed texts: root cause, supporting metrics and action items of the six kinds
CAUSES = {
    "bn_gc_pressure": Cause(
        "Memory Pressure / Excessive GC Overhead",
        {"gc_overhead_percentage": percent(GC, 2), "memory_spilled_bytes": "memory_bytes_spilled", "memory_spilled_formatted": format_bytes("memory_bytes_spilled")},
        ("Tune GC settings: Consider G1GC with -XX:+UseG1GC", "Review spark.memory.fraction (default: 0.6)",
         "Check for memory leaks in UDFs or transformations", "Consider increasing spark.memory.storageFraction if caching is heavy"),
        f"concat('Increase executor memory: spark.executor.memory (current impact: ', {percent(GC)}, ' GC time)')"),
    "bn_shuffle": Cause(
        "Excessive Shuffle Operations",
        {"shuffle_time_percentage": percent(SH, 2), "shuffle_read_formatted": format_bytes("shuffle_read_bytes"),
         "shuffle_write_formatted": format_bytes("shuffle_write_bytes"), "total_shuffle_formatted": format_bytes(_SHUFFLED)},
        ("Enable Adaptive Query Execution: spark.sql.adaptive.enabled=true", "Optimize shuffle partitions: spark.sql.shuffle.partitions (default: 200)",
         "Use broadcast joins for small tables: spark.sql.autoBroadcastJoinThreshold", "Repartition data before shuffle-heavy operations",
         "Consider using reduceByKey instead of groupByKey where applicable", "Enable shuffle compression: spark.shuffle.compress=true")),
    "bn_data_skew": Cause(
        "Data Skew / Uneven Partition Distribution",
        {"task_skew_ratio": num(SK, 2), "mean_task_duration_ms": num("mean_task_duration", 1), "max_task_duration_ms": "max_task_duration",
         "min_task_duration_ms": "min_task_duration", "duration_range_ms": "max_task_duration - min_task_duration",
         "slowest_vs_fastest_ratio": f"IF(min_task_duration > 0, concat({num('try_divide(max_task_duration, min_task_duration)', 2)}, 'x'), 'N/A')",
         "total_tasks": "total_tasks"},
        ("Enable Adaptive Query Execution for skew handling: spark.sql.adaptive.enabled=true", "Enable skew join optimization: spark.sql.adaptive.skewJoin.enabled=true",
         "Repartition by key with salt: df.repartition('key', 'salt')", "Use approximate percentiles to identify skewed keys",
         "Consider filtering out or handling outlier keys separately", "Increase parallelism for skewed stages")),
    "bn_cpu_underuse": Cause(
        "CPU Underutilization",
        {"cpu_efficiency_percentage": percent(EFF, 2), "cpu_waste_percentage": percent(f"(1D - {EFF})", 2)},
        ("Check for I/O bottlenecks causing CPU idle time", "Verify data locality: review spark.locality.wait", "Increase parallelism: spark.default.parallelism",
         "Review serialization overhead: use Kryo serializer", "Check network bandwidth if shuffle-heavy"),
        f"concat('Increase cores per executor: spark.executor.cores (current utilization: ', {percent(EFF)}, ')')"),
    "bn_executor_imbalance": Cause(
        "Executor Load Imbalance",
        {"imbalance_ratio": num(IMB, 2), "total_executors": "total_executors", "min_tasks_per_executor": "min_tasks_per_executor",
         "max_tasks_per_executor": "max_tasks_per_executor", "avg_tasks_per_executor": num("mean_tasks_per_executor", 1),
         "task_distribution_range": "max_tasks_per_executor - min_tasks_per_executor"},
        ("Ensure even data distribution across partitions", "Check for skewed joins or aggregations", "Review partitioning strategy: consider repartition() or coalesce()",
         "Enable dynamic allocation: spark.dynamicAllocation.enabled=true", "Verify no stragglers due to data locality issues", "Check executor loss patterns in Spark UI")),
    "bn_memory_spill": Cause(
        "Insufficient Memory / Memory Spill",
        {"memory_spilled_bytes": "memory_bytes_spilled", "memory_spilled_formatted": format_bytes("memory_bytes_spilled"), "spill_ratio_percentage": percent(SPILL, 2)},
        ("Increase executor memory: spark.executor.memory", "Adjust memory overhead: spark.executor.memoryOverhead",
         "Tune off-heap memory: spark.memory.offHeap.enabled=true", "Reduce shuffle partition size to fit in memory", "Consider external shuffle service",
         "Review sorting and aggregation operations")),
}
HEALTHY = ("No dominant bottleneck detected", "Application appears to be running efficiently. Continue monitoring for anomalies.")
# -----------------------------------------------------------------------------

_NO_ACTIONS = "CAST(array() AS ARRAY<STRING>)"
_ANY = " OR ".join(f"({d.condition})" for d in DETECTORS.values())
_COUNT = " + ".join(f"IF({d.condition}, 1, 0)" for d in DETECTORS.values())


def _cause(name: str, detector: str, severity: str, confidence: str, metrics: str, advice: str, actions: str) -> str:
    return (f"named_struct('root_cause', {lit(name)}, 'detector', {detector}, 'severity', {severity}, 'confidence', {confidence}, "
            f"'supporting_metrics', {metrics}, 'recommendation', {advice}, 'action_items', {actions})")


def _found(name: str) -> tuple[str, str]:
    c, d = CAUSES[name], DETECTORS[name]
    actions = "array(" + ", ".join([c.first_action] * (c.first_action is not None) + [lit(a) for a in c.actions]) + ")"
    found = d.struct(name)
    return d.condition, _cause(c.name, f"'{name}'", d.severity, f"({found}).confidence", str_map(**c.supporting, impact=d.impact), RECOMMENDATIONS[name], actions)


def _overview() -> tuple[str, str]:
    figures = str_map(total_tasks="total_tasks", total_input_data=format_bytes("input_bytes"), total_output_data=format_bytes("output_bytes"),
                      total_shuffle_data=format_bytes(_SHUFFLED), identified_bottlenecks=_COUNT)
    advice = f"concat('Found ', {_COUNT}, ' performance bottleneck(s). Review and address in priority order above.')"
    return _ANY, _cause("System Overview", "'overview'", "'INFO'", "1D", figures, advice, _NO_ACTIONS)


def _healthy() -> tuple[str, str]:
    figures = str_map(cpu_efficiency=percent(EFF, 2), gc_overhead=percent(GC, 2), task_count="total_tasks", avg_task_duration_ms=num("mean_task_duration", 2))
    return f"NOT ({_ANY})", _cause(HEALTHY[0], "'healthy'", "CAST(NULL AS STRING)", "1D", figures, lit(HEALTHY[1]), _NO_ACTIONS)


def _explode(metrics: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return metrics.selectExpr("app_id", f"explode({links(*pairs)}) AS c").selectExpr("app_id", "c.*")


def root_causes(metrics: DataFrame) -> DataFrame:
    """One row per finding with its cause, figures, recommendation and actions, straight from the metrics row."""
    return _explode(metrics, *[_found(n) for n in CAUSES])


def root_cause_healthy(metrics: DataFrame) -> DataFrame:
    """One row for every application in which no detector fires."""
    return _explode(metrics, _healthy())


def system_overview(metrics: DataFrame) -> DataFrame:
    """One INFO row for every application with findings."""
    return _explode(metrics, _overview())


def all_root_causes(metrics: DataFrame) -> DataFrame:
    """Causes, overview and healthy rows in one pass."""
    return _explode(metrics, *[_found(n) for n in CAUSES], _overview(), _healthy())


def recommendation_texts(metrics: DataFrame) -> DataFrame:
    """The text that each ladder gives for the figures of each application, whether or not its detector fires."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in RECOMMENDATIONS.items())
    return metrics.selectExpr("app_id", f"stack({len(RECOMMENDATIONS)}, {pairs}) AS (detector, recommendation)")


# --- cause chains -------------------------------------------------------------------------------
def primary_symptom(details: DataFrame) -> DataFrame:
    """Failed stage first, then the first CRITICAL, the first HIGH or else the first issue."""
    candidates = "concat(filter(issues, i -> i.severity = 'CRITICAL'), filter(issues, i -> i.severity = 'HIGH'), issues)"
    return details.selectExpr("*", f"""CASE
        WHEN status = 'FAILED' THEN named_struct('type', 'STAGE_FAILURE', 'severity', 'CRITICAL',
                                                 'description', concat('Stage failed: ', coalesce(failure_reason, 'Unknown')))
        WHEN size(issues) = 0 THEN named_struct('type', 'NO_ISSUE', 'severity', 'INFO', 'description', 'Stage completed successfully')
        ELSE transform({candidates}, i -> named_struct('type', i.type, 'severity', i.severity, 'description', i.description))[0]
        END AS symptom""")


def _link(event: str, reason: str = "CAST(NULL AS STRING)", **metrics: str) -> str:
    return f"named_struct('event', {event}, 'reason', {reason}, 'metrics', {str_map(**metrics)})"


_PRESSURE = "executor_failures > 0 AND oom_events > 0 AND (gc_ratio > 0.2D OR total_memory_spilled > 0)"
_FETCH = "fetch_failures > 0 AND contains(failure_reason, 'FetchFailed')"
_PLAIN = f"executor_failures = 0 AND NOT coalesce({_FETCH}, false)"

# Fixed texts: links of the failure chain in order, each with its condition
FAILURE_LINKS = links(
    ("true", _link("concat('Stage ', stage_id, ' failed')", "coalesce(failure_reason, '')")),
    ("executor_failures > 0", _link("concat('Executor(s) lost: ', executor_failures, ' executor failure(s)')", "'Executor failure preceded stage failure'",
                                    failed_executors="executor_failures")),
    ("executor_failures > 0 AND oom_events > 0", _link("'Out of Memory (OOM) detected'", "'Memory exhaustion caused executor loss'", oom_count="oom_events")),
    (_PRESSURE, _link("'High memory pressure detected'", "'Memory pressure led to OOM'", gc_overhead=percent("gc_ratio"),
                      memory_spilled=format_bytes("total_memory_spilled", True))),
    (_PRESSURE, _link("'ROOT CAUSE: Insufficient executor memory'", "'Executor memory allocation too low for workload'", recommendation="'Increase spark.executor.memory'")),
    (_FETCH, _link("concat('Shuffle fetch failure: ', fetch_failures, ' fetch failure(s)')", "'Network or executor issues during shuffle'", fetch_failures="fetch_failures")),
    (f"{_FETCH} AND shuffle_ratio > 0.5D", _link("'Heavy shuffle operations detected'", "'Large data movement increases failure probability'", shuffle_ratio=percent("shuffle_ratio"))),
    (f"{_FETCH} AND shuffle_ratio > 0.5D", _link("'ROOT CAUSE: Network instability or shuffle service issues'", "'Shuffle service may be overwhelmed or network unstable'",
                                                 recommendation="'Enable external shuffle service, reduce shuffle volume'")),
    (f"{_PLAIN} AND gc_ratio > 0.3D", _link("'Critical GC overhead detected'", gc_overhead=percent("gc_ratio"))),
    (f"{_PLAIN} AND gc_ratio > 0.3D", _link("'ROOT CAUSE: Memory pressure / GC thrashing'", recommendation="'Increase executor memory and tune GC'")),
    (f"{_PLAIN} AND gc_ratio <= 0.3D AND task_skew > 1.0D", _link("'Severe data skew detected'", task_skew=num("task_skew", 2))),
    (f"{_PLAIN} AND gc_ratio <= 0.3D AND task_skew > 1.0D", _link("'ROOT CAUSE: Uneven data distribution'", recommendation="'Repartition data and handle skewed keys'")),
    (f"{_PLAIN} AND gc_ratio <= 0.3D AND task_skew <= 1.0D", _link("'ROOT CAUSE: Unknown - Review stage logs for details'", recommendation="'Check application logs and Spark UI'")),
)

_FIRST = "issues[0].type"
# Fixed texts: links of the performance chain, chosen by the first issue
PERFORMANCE_LINKS = links(
    (f"{_FIRST} = 'HIGH_GC'", _link("concat('Stage ', stage_id, ' experiencing high GC overhead')", gc_overhead=percent("gc_ratio"))),
    (f"{_FIRST} = 'HIGH_GC' AND total_memory_spilled > 0", _link("'Memory spill detected'", memory_spilled=format_bytes("total_memory_spilled", True))),
    (f"{_FIRST} = 'HIGH_GC'", _link("'ROOT CAUSE: Insufficient memory allocation'", recommendation="'Increase spark.executor.memory by 30-50%'")),
    (f"{_FIRST} = 'DATA_SKEW'", _link("concat('Stage ', stage_id, ' has uneven task distribution')", task_skew=num("task_skew", 2),
                                      max_task_duration=f"concat({num('max_task_duration_ms', 0)}, 'ms')", mean_task_duration=f"concat({num('mean_task_duration_ms', 0)}, 'ms')")),
    (f"{_FIRST} = 'DATA_SKEW' AND is_wide_transformation", _link("concat('Wide transformation detected: ', operation)", transformation_type="transformation_type")),
    (f"{_FIRST} = 'DATA_SKEW'", _link("'ROOT CAUSE: Data skew in partition distribution'", recommendation="'Enable AQE skew handling or use salting technique'")),
    (f"{_FIRST} = 'MEMORY_SPILL'", _link("concat('Stage ', stage_id, ' spilling data to disk')", memory_spilled=format_bytes("total_memory_spilled", True))),
    (f"{_FIRST} = 'MEMORY_SPILL'", _link("'Memory pressure exceeds available executor memory'", gc_overhead=percent("gc_ratio"))),
    (f"{_FIRST} = 'MEMORY_SPILL'", _link("'ROOT CAUSE: Working set too large for memory'", recommendation="'Increase executor memory or reduce data volume per partition'")),
    (f"{_FIRST} = 'EXCESSIVE_SHUFFLE'", _link("concat('Stage ', stage_id, ' has heavy shuffle operations')", shuffle_ratio=percent("shuffle_ratio"),
                                              shuffle_data=format_bytes("total_shuffle_read", True))),
    (f"{_FIRST} = 'EXCESSIVE_SHUFFLE'", _link("concat('Transformation causing shuffle: ', operation)", transformation_type="transformation_type")),
    (f"{_FIRST} = 'EXCESSIVE_SHUFFLE'", _link("'ROOT CAUSE: Inefficient shuffle strategy'", recommendation="'Use broadcast join for small tables or reduce shuffle partitions'")),
)

CORRELATED = {
    "GC__Overhead__%": percent("gc_ratio"), "Task__Skew__Ratio": num("task_skew", 2), "Memory__Spilled": format_bytes("total_memory_spilled", True),
    "Shuffle__Read": format_bytes("total_shuffle_read", True), "Total__Duration": format_duration("total_duration_ms"), "Task__Count": "total_tasks",
    "Mean__Task__Duration": f"concat({num('mean_task_duration_ms', 0)}, 'ms')", "Max__Task__Duration": f"concat({num('max_task_duration_ms', 0)}, 'ms')",
    "GC__vs__Duration__Correlation": num("gc_vs_duration", 3), "Spill__vs__GC__Correlation": num("spill_vs_gc", 3),
}


def chain_confidence(chain: str = "chain") -> str:
    return (f"CASE WHEN size({chain}) = 0 THEN 0D ELSE least(0.5D + least(size({chain}) * 0.1D, 0.3D) + IF(exists({chain}, l -> size(l.metrics) > 0), 0.15D, 0D) "
            f"+ IF(exists({chain}, l -> contains(l.event, 'ROOT CAUSE')), 0.1D, 0D), 1D) END")


#: Width of the time buckets of running counts. A bucket holds at most so many distinct times, however many events come at one.
BUCKET_MS = 60_000


def counted_between(events: DataFrame, spans: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``spans`` (app_id, lo, hi, ...) with ``n``, the number of ``events`` (app_id, ts_ms) from ``lo`` to ``hi``, both included.

    A sweep: the number up to ``hi`` less the number before ``lo``, from running counts over the times of both tables together,
    so no pair of an event and a span is formed. Events are first added up per time. Counts run inside time buckets, on top of
    what the buckets before hold; that is a sum over one row for each bucket, so an application is never one task's events.
    Spans with a null end count 0, as do those that end before they begin.
    """
    step = int(bucket_ms)
    at = events.filter("ts_ms IS NOT NULL").groupBy("app_id", F.col("ts_ms").alias("at")).agg(F.count("*").alias("n"))
    ends = spans.filter("lo <= hi").select("app_id", "lo", "hi").distinct()
    probes = ends.selectExpr("app_id", "lo", "hi", "explode(array(struct(lo - 1 AS at, -1L AS sign), struct(hi AS at, 1L AS sign))) AS p").select("app_id", "p.at", "p.sign", "lo", "hi")
    marks = at.selectExpr("app_id", "at", "n", "0L AS sign", "CAST(NULL AS BIGINT) AS lo", "CAST(NULL AS BIGINT) AS hi").unionByName(probes.withColumn("n", F.lit(0).cast("long")))
    marks = marks.withColumn("bucket", F.floor(F.col("at") / step))
    before = F.sum("held").over(Window.partitionBy("app_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.groupBy("app_id", "bucket").agg(F.sum("n").alias("held")).select("app_id", "bucket", F.coalesce(before, F.lit(0)).alias("carried"))
    running = F.sum("n").over(Window.partitionBy("app_id", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))  # equal times count together
    upto = marks.withColumn("upto", running).filter("sign <> 0").join(carried, ["app_id", "bucket"])
    counts = upto.groupBy("app_id", "lo", "hi").agg(F.sum(F.expr("sign * (upto + carried)")).alias("n"))
    return spans.join(counts, ["app_id", "lo", "hi"], "left").fillna(0, ["n"])


def nearby_executor_failures(details: DataFrame, executor_events: DataFrame, within_ms: int) -> DataFrame:
    """Number of failed executors within ``within_ms`` of the end of a failed stage; stages without one are left out."""
    step = int(within_ms)
    ends = details.filter("status = 'FAILED' AND completion_ms IS NOT NULL").selectExpr("app_id", "stage_id", f"completion_ms - {step} AS lo", f"completion_ms + {step} AS hi")
    lost = executor_events.filter(f"kind = 'REMOVED' AND {is_executor_failure('reason')}").select("app_id", "ts_ms")
    return counted_between(lost, ends).filter("n > 0").selectExpr("app_id", "stage_id", "n AS executor_failures")


def cause_chains(details: DataFrame, failure_counts: DataFrame, correlations: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Symptom, chain, correlated metrics and confidence of every stage.

    ``failure_counts`` and ``correlations`` have one row per application.  With ``near`` only executor failures
    close in time to the stage are counted; without it all of the application, as in the single-log case.
    """
    app = failure_counts.selectExpr("app_id", "total_executor_failures AS executor_failures", "total_oom_events AS oom_events", "total_fetch_failures AS fetch_failures")
    rows = primary_symptom(details).join(app, "app_id", "left").join(correlations.select("app_id", "gc_vs_duration", "spill_vs_gc"), "app_id", "left")
    if near is not None:
        rows = rows.drop("executor_failures").join(near, ["app_id", "stage_id"], "left")
    rows = rows.fillna(0, ["executor_failures", "oom_events", "fetch_failures", "gc_vs_duration", "spill_vs_gc"])
    return rows.selectExpr(
        "app_id", "stage_id", "stage_name", "status", "symptom", "issues",
        f"CASE WHEN status = 'FAILED' THEN {FAILURE_LINKS} WHEN size(issues) > 0 THEN {PERFORMANCE_LINKS} ELSE array() END AS chain",
        f"{str_map(**CORRELATED)} AS correlated_metrics").selectExpr("*", f"{chain_confidence()} AS confidence")


def explore_failures(chains: DataFrame) -> DataFrame:
    """Chains of failed stages and of other stages with a CRITICAL issue."""
    return chains.filter("exists(issues, i -> i.type = 'STAGE_FAILURE' OR i.severity = 'CRITICAL')")


def cause_chain_for_stage(chains: DataFrame, app_id: str, stage_id: int) -> DataFrame:
    """The chain of one stage; no row means the stage is not in the log."""
    return chains.filter((F.col("app_id") == app_id) & (F.col("stage_id") == stage_id))


def chain_report_lines(chains: DataFrame) -> DataFrame:
    """(app_id, chain_no, line_no, line): text of each chain; sort by the two numbers to print."""
    rule = "repeat('-', 80)"
    body = ("flatten(transform(chain, (l, j) -> concat(array(concat(repeat('  ', j + 1), IF(j + 1 = size(chain), '└─> ', '├─> '), l.event)), "
            "transform(map_entries(l.metrics), e -> concat(repeat('  ', j + 1), '    • ', e.key, ': ', e.value)))))")
    lines = (f"concat(array(concat('[CHAIN ', chain_no, '] Stage ', stage_id, ': ', stage_name), {rule}, concat('Primary Symptom: ', symptom.type, ' [', symptom.severity, ']'), "
             f"concat('Description: ', symptom.description), '', 'Probable Cause Chain:'), {body}, array('', 'Correlated Metrics at Failure:'), "
             "transform(map_entries(correlated_metrics), e -> concat('  • ', e.key, ': ', e.value)), "
             f"array('', concat('Chain Confidence: ', {num('confidence * 100D', 0)}, '%'), ''))")
    return chains.selectExpr("*", "row_number() OVER (PARTITION BY app_id ORDER BY stage_id) AS chain_no").selectExpr(
        "app_id", "chain_no", "stage_id", f"posexplode({lines}) AS (line_no, line)")


# Symptom -> metrics to check and probable causes
CANDIDATES = (
    ("executor_lost", "total_executor_failures", ("gc_time", "memory_spill", "oom_events"), ("memory_pressure", "oom", "resource_exhaustion")),
    ("stage_failure", "total_stage_failures", ("task_failures", "executor_lost", "fetch_failures"), ("executor_failure", "network_issue", "data_corruption")),
    ("task_failure", "total_task_failures", ("memory_spill", "gc_time", "shuffle_fetch_time"), ("oom", "fetch_failure", "timeout")),
)


def cause_candidates(failure_counts: DataFrame) -> DataFrame:
    """(app_id, symptom, occurrences, check_metrics, probable_cause) for the symptoms that occurred."""
    def arr(xs):
        return "array(" + ", ".join(f"'{x}'" for x in xs) + ")"

    found = links(*[(f"{n} > 0", f"named_struct('symptom', '{s}', 'occurrences', {n}, 'check_metrics', {arr(m)}, 'causes', {arr(c)})") for s, n, m, c in CANDIDATES])
    return failure_counts.selectExpr("app_id", f"explode({found}) AS s").selectExpr(
        "app_id", "s.symptom", "s.occurrences", "s.check_metrics", "explode(s.causes) AS probable_cause")
