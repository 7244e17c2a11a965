"""Declarative rules over (app_id, metric, value): a rule fires when all its patterns hold.

Rules, thresholds and recommendations are tables that a user may extend, so joins carry no hint: the
planner broadcasts them as long as they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.text import lit, severity_rank

# Fixed values: (rule, detector of the same cause, confidence boost, patterns) --
RULES = (
    ("Memory Pressure / GC Overhead", "bn_gc_pressure", 0.15, (("gc_overhead_ratio", ">", 0.2), ("memory_bytes_spilled", ">", 0.0))),
    ("Data Skew / Partition Imbalance", "bn_data_skew", 0.10, (("task_skew_ratio", ">", 0.5), ("stragglers_percentage", ">", 5.0))),
    ("CPU Underutilization / I/O Bottleneck", "bn_cpu_underuse", 0.12, (("cpu_efficiency", "<", 0.6), ("shuffle_ratio", ">", 0.3))),
    ("Memory Spill to Disk", "bn_memory_spill", 0.18, (("memory_bytes_spilled", ">", 0.0), ("spill_ratio", ">", 0.1))),
    ("Excessive Shuffle Overhead", "bn_shuffle", 0.10, (("shuffle_ratio", ">", 0.5),)),
    ("Executor Load Imbalance", "bn_executor_imbalance", 0.08, (("executor_imbalance_ratio", ">", 0.4),)),
)

# Severity -> metric -> bound (cpu_efficiency is bad when below)
THRESHOLDS = {
    "CRITICAL": {"gc_overhead_ratio": 0.4, "task_skew_ratio": 1.0, "spill_ratio": 0.3, "shuffle_ratio": 0.7},
    "HIGH": {"gc_overhead_ratio": 0.2, "task_skew_ratio": 0.5, "spill_ratio": 0.1, "shuffle_ratio": 0.5, "executor_imbalance_ratio": 0.6},
    "MEDIUM": {"gc_overhead_ratio": 0.1, "task_skew_ratio": 0.3, "spill_ratio": 0.05, "shuffle_ratio": 0.3, "executor_imbalance_ratio": 0.4,
               "cpu_efficiency": 0.75},
}

# Weights of the calibrated confidence
CALIBRATION = {"base": 0.50, "impact": 0.35, "correlation": 0.25, "evidence": 0.20, "statistical": 0.20}

# Fixed texts: rule -> severity -> recommendations
RECOMMENDATIONS = {
    "Memory Pressure / GC Overhead": {
        "CRITICAL": ("IMMEDIATE: Increase spark.executor.memory by 50-100%",
                     "Enable G1GC: -XX:+UseG1GC -XX:InitiatingHeapOccupancyPercent=35",
                     "Reduce spark.memory.storageFraction if heavy caching (default: 0.5)",
                     "Review and optimize memory-intensive transformations"),
        "HIGH": ("Increase spark.executor.memory by 25-30%",
                 "Tune GC settings: Consider G1GC with appropriate heap thresholds",
                 "Review spark.memory.fraction (default: 0.6)",
                 "Check for memory leaks in UDFs"),
        "MEDIUM": ("Monitor GC patterns in Spark UI",
                   "Consider increasing memory if GC increases over time"),
    },
    "Data Skew / Partition Imbalance": {
        "CRITICAL": ("IMMEDIATE: Enable AQE skew join: spark.sql.adaptive.skewJoin.enabled=true",
                     "Apply salting technique: df.withColumn('salt', rand() % N)",
                     "Identify and isolate skewed keys for separate processing",
                     "Consider custom partitioner for known skewed keys"),
        "HIGH": ("Enable Adaptive Query Execution: spark.sql.adaptive.enabled=true",
                 "Use salting for skewed joins: repartition with salt column",
                 "Increase parallelism for skewed stages",
                 "Review join strategies and partition distribution"),
        "MEDIUM": ("Monitor partition sizes in Spark UI",
                   "Use repartition() before shuffle-heavy operations"),
    },
    "CPU Underutilization / I/O Bottleneck": {
        "CRITICAL": ("IMMEDIATE: Increase cores per executor: spark.executor.cores",
                     "Check network bandwidth and disk I/O capacity",
                     "Enable compression: spark.shuffle.compress=true, spark.io.compression.codec=snappy",
                     "Verify network configuration and locality wait times"),
        "HIGH": ("Increase spark.executor.cores and spark.default.parallelism",
                 "Review data locality: spark.locality.wait settings",
                 "Use Kryo serialization: spark.serializer=org.apache.spark.serializer.KryoSerializer",
                 "Check for network bottlenecks in shuffle operations"),
        "MEDIUM": ("Monitor CPU utilization patterns",
                   "Review serialization overhead in Spark UI"),
    },
    "Memory Spill to Disk": {
        "CRITICAL": ("IMMEDIATE: Increase spark.executor.memory by 50%",
                     "Increase spark.executor.memoryOverhead by 20-30%",
                     "Enable off-heap memory: spark.memory.offHeap.enabled=true",
                     "Reduce shuffle partition size to fit in memory"),
        "HIGH": ("Increase executor memory: spark.executor.memory",
                 "Tune spark.memory.fraction and spark.memory.storageFraction",
                 "Review and optimize sorting/aggregation operations",
                 "Consider external shuffle service"),
        "MEDIUM": ("Monitor memory spill patterns",
                   "Review memory-intensive operations"),
    },
    "Excessive Shuffle Overhead": {
        "CRITICAL": ("IMMEDIATE: Enable broadcast joins for small tables",
                     "Set spark.sql.autoBroadcastJoinThreshold=100MB (or higher)",
                     "Enable AQE: spark.sql.adaptive.enabled=true",
                     "Review and optimize join strategies"),
        "HIGH": ("Optimize shuffle partitions: spark.sql.shuffle.partitions",
                 "Use broadcast joins where applicable",
                 "Enable shuffle compression: spark.shuffle.compress=true",
                 "Consider reduceByKey instead of groupByKey"),
        "MEDIUM": ("Monitor shuffle read/write patterns",
                   "Review partitioning strategy before shuffles"),
    },
    "Executor Load Imbalance": {
        "CRITICAL": ("IMMEDIATE: Repartition data evenly: df.repartition(N, 'key')",
                     "Enable dynamic allocation: spark.dynamicAllocation.enabled=true",
                     "Investigate and fix data skew at source",
                     "Review executor placement and data locality"),
        "HIGH": ("Ensure even data distribution across partitions",
                 "Enable dynamic allocation if not already enabled",
                 "Check for skewed joins or aggregations",
                 "Review executor logs for anomalies"),
        "MEDIUM": ("Monitor executor task distribution",
                   "Use coalesce() for reducing partitions after filters"),
    },
}
# -----------------------------------------------------------------------------


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A static table as SQL VALUES: a local relation, no Python rows shipped to executors."""
    def cell(x):
        return lit(x) if isinstance(x, str) else f"{x}D" if isinstance(x, float) else f"{x}"

    body = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """One row per pattern: (rule, detector, boost, patterns, metric, op, threshold)."""
    return _values(spark, "rule, detector, boost, patterns, metric, op, threshold",
                   [(n, d, b, len(ps), m, op, t) for n, d, b, ps in rules for m, op, t in ps])


def thresholds_table(spark: SparkSession) -> DataFrame:
    return _values(spark, "severity, metric, op, threshold",
                   [(s, m, "<" if m == "cpu_efficiency" else ">", t) for s, ms in THRESHOLDS.items() for m, t in ms.items()])


def recommendations_table(spark: SparkSession) -> DataFrame:
    return _values(spark, "rule, severity, position, recommendation",
                   [(r, s, i, t) for r, by in RECOMMENDATIONS.items() for s, ts in by.items() for i, t in enumerate(ts)])


HOLDS = ("CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold "
         "WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold ELSE raise_error(concat('unknown operator in a rule: ', op)) END")


def rules_eval(metrics_long: DataFrame, rules: DataFrame) -> DataFrame:
    """(app_id, rule, matched, total, fires) for every application and every rule with a metric that the application has."""
    rows = metrics_long.join(rules, "metric").selectExpr("app_id", "rule", "detector", "boost", "patterns", f"{HOLDS} AS hold")
    return rows.groupBy("app_id", "rule", "detector", "boost", "patterns").agg(F.expr("count_if(hold) AS matched")).selectExpr(
        "app_id", "rule", "detector", "boost", "matched", "patterns AS total", "matched = patterns AS fires")


def severity_from_thresholds(metrics_long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Worst severity whose bound a metric passes; metrics within all bounds give no row."""
    hit = metrics_long.join(thresholds, "metric").filter(HOLDS)
    worst = hit.groupBy("app_id", "metric").agg(F.expr(f"min({severity_rank('severity')}) AS sev_rank"), F.expr("max(value) AS value"))
    return worst.selectExpr("app_id", "metric", "value", "sev_rank", "element_at(array('CRITICAL', 'HIGH', 'MEDIUM'), CAST(sev_rank AS INT) + 1) AS severity")


def rule_recommendations(metrics_long: DataFrame, rules: DataFrame, thresholds: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Recommendations of the rules that fire, at the worst severity of the rule's metrics (MEDIUM if none is listed).

    Patterns and thresholds are joined in one pass over the metrics, then reduced to one row per rule.
    """
    bounds = thresholds.groupBy("metric").agg(F.expr("collect_list(struct(severity, op, threshold)) AS bounds"))
    rows = metrics_long.join(rules, "metric").join(bounds, "metric", "left").selectExpr(
        "app_id", "rule", "patterns", f"{HOLDS} AS hold",
        f"array_min(transform(filter(bounds, b -> IF(b.op = '<', value < b.threshold, value > b.threshold)), b -> {severity_rank('b.severity')})) AS r")
    fired = rows.groupBy("app_id", "rule", "patterns").agg(F.expr("count_if(hold) AS matched"), F.expr("coalesce(min(r), 2) AS r")).filter("matched = patterns")
    fired = fired.selectExpr("app_id", "rule", "element_at(array('CRITICAL', 'HIGH', 'MEDIUM'), CAST(r AS INT) + 1) AS severity")
    return fired.join(recommendations, ["rule", "severity"])


def rule_confidence(evaluated: DataFrame, findings: DataFrame) -> DataFrame:
    """Confidence of a finding raised by its rule, and a calibrated one that weighs impact, correlation, evidence and matched patterns."""
    w = CALIBRATION
    weighed = (f"{w['impact']}D * impact_score + {w['correlation']}D * least(correlation, 1D) + {w['evidence']}D * IF(has_evidence, 1D, 0D) "
               f"+ {w['statistical']}D * (matched / total)")
    return evaluated.filter("matched > 0").join(findings.select("app_id", "detector", "confidence", "impact_score", "correlation", "has_evidence"), ["app_id", "detector"]).selectExpr(
        "app_id", "rule", "detector", "matched", "total", "fires", "confidence", "boost",
        "IF(fires, least(1D, confidence + boost), confidence) AS boosted_confidence",
        f"least(1D, {w['base']}D + (1D - {w['base']}D) * ({weighed})) AS calibrated_confidence")
