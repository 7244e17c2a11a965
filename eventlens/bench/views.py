"""The canonical tables as projections of ``lineitem``, ``orders`` and ``events``.

Every view is a list of SQL expressions that mean the same in Spark and in DuckDB
apart from the few tokens swapped in ``_dialect``; so the Spark side and the
oracle side start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import metrics, parts
from eventlens.plans.stash import stash

STAGE_NAMES = ("join at Etl:10", "leftOuterJoin at Etl:21", "groupByKey at Etl:32", "aggregateByKey at Etl:43",
               "repartition at Etl:54", "sortByKey at Etl:65", "persist at Etl:76", "distinct exchange at Etl:87",
               "reduceByKey shuffle at Etl:98", "map at Etl:109")
STAGE_FAILURES = ("java.lang.OutOfMemoryError: Java heap space", "FetchFailed: missing an output location",
                  "ExecutorLostFailure (executor 3 exited)", "java.net.ConnectException: Connection refused",
                  "No space left on device", "TimeoutException: futures timed out", "user code raised an exception")
TASK_FAILURES = (("ExceptionFailure", "java.lang.OutOfMemoryError: Java heap space"),
                 ("FetchFailed", "Block lost on executor"), ("ExecutorLostFailure", "Executor 7 lost"),
                 ("ExceptionFailure", "Connection refused"), ("ExceptionFailure", "No space left on device"),
                 ("ExceptionFailure", "TimeoutException after 120 s"), ("TaskKilled", "another attempt succeeded"))
REMOVALS = ("Executor heartbeat timed out after 120000 ms", "Container killed for exceeding memory limits",
            "Executor 7 lost", "java.lang.OutOfMemoryError: Java heap space", "Idle for 60 s",
            "Connection reset by peer, worker failed")


def _pick(expr: str, texts) -> str:
    arms = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE {expr} {arms} END"


_REASON = ("CASE WHEN l_returnflag='R' AND l_linestatus='F' AND l_partkey % 50 < 7 THEN "
           + _pick("l_partkey % 50", [t[0] for t in TASK_FAILURES]) + " ELSE 'Success' END")
_MESSAGE = ("CASE WHEN l_returnflag='R' AND l_linestatus='F' AND l_partkey % 50 < 7 THEN "
            + _pick("l_partkey % 50", [t[1] for t in TASK_FAILURES]) + " END")

# level 1, 2, 3 of the task projection
TASK_1 = [
    ("a", "l_orderkey % 8"), ("stage_id", "l_orderkey % 400"),
    ("stage_attempt", "CASE WHEN (l_orderkey % 400) % 29 = 0 THEN CAST(l_linenumber AS BIGINT) % 2 ELSE CAST(0 AS BIGINT) END"),
    ("task_id", "l_orderkey * 10 + l_linenumber"), ("attempt", "CAST(0 AS BIGINT)"),
    ("executor_id", "'exec-' || CAST(l_suppkey % 16 + 4 AS STRING)"),
    ("host", "'host-' || CAST(l_suppkey % 16 % 5 AS STRING)"),
    ("locality", _pick("l_linenumber % 3", ("PROCESS_LOCAL", "NODE_LOCAL", "ANY"))),
    ("speculative", "l_partkey % 41 = 0"), ("ln", "CAST(l_linenumber AS BIGINT)"), ("pk", "l_partkey"),
    ("q", "CAST(l_quantity AS BIGINT)"), ("d100", "CAST(round(l_discount*100) AS BIGINT)"),
    ("t100", "CAST(round(l_tax*100) AS BIGINT)"), ("cents", "CAST(round(l_extendedprice*100) AS BIGINT)"),
    ("ship_ms", "EPOCHMS(l_shipdate)"), ("end_reason", _REASON), ("message", _MESSAGE),
]
TASK_2 = [("duration_ms", "CASE WHEN a = 0 THEN 5000 + 10*q ELSE 100*q + CASE WHEN a IN (1,3,5) AND pk % 97 = 0 "
                          "THEN 20000 ELSE 0 END END")]
TASK_3 = [
    ("app_id", "'app-' || CAST(a AS STRING)"), ("stage_id", "stage_id"), ("stage_attempt", "stage_attempt"),
    ("task_id", "task_id"), ("attempt", "attempt"), ("executor_id", "executor_id"), ("host", "host"),
    ("locality", "locality"), ("speculative", "speculative"), ("launch_ms", "ship_ms + ln*1000"),
    ("finish_ms", "ship_ms + ln*1000 + duration_ms"), ("duration_ms", "duration_ms"), ("end_reason", "end_reason"),
    ("end_reason_json", "CASE WHEN message IS NULL THEN '{\"Reason\":\"Success\"}' ELSE '{\"Reason\":\"' || end_reason "
                        "|| '\",\"Message\":\"' || message || '\"}' END"),
    ("run_ms", "duration_ms - 50"), ("cpu_ns", "(duration_ms - 50)*10000*(100 - 10*a)"),
    ("gc_ms", "((duration_ms - 50)*d100*a) DIV 80"), ("minor_gc_ms", "(((duration_ms - 50)*d100*a) DIV 80)*3 DIV 4"),
    ("major_gc_ms", "((duration_ms - 50)*d100*a) DIV 80 - (((duration_ms - 50)*d100*a) DIV 80)*3 DIV 4"),
    ("deser_ms", "ln*5"), ("heap_bytes", "q*1000000"), ("offheap_bytes", "a*q*10000"), ("result_bytes", "1000 + q"),
    ("mem_spill_bytes", "CASE WHEN t100 >= 6 AND a >= 4 THEN cents*10 ELSE 0 END"),
    ("disk_spill_bytes", "CASE WHEN t100 >= 6 AND a >= 6 THEN cents*5 ELSE 0 END"),
    ("sh_read_bytes", "CASE WHEN ln <= 3 THEN cents*a*10 ELSE 0 END"),
    ("fetch_wait_ms", "((duration_ms - 50)*a) DIV 10"), ("sh_write_bytes", "cents"),
    ("sh_write_time", "(duration_ms - 50) DIV 20"), ("sh_write_records", "q*10"),
    ("in_bytes", "cents*20"), ("in_records", "q*100"),
    ("out_bytes", "CASE WHEN a = 0 THEN 0 ELSE cents*2 END"), ("out_records", "q"),
]

STAGE_AGG = [("sub_ms", "EPOCHMS(min(o_orderdate))"), ("comp_ms", "EPOCHMS(max(o_orderdate)) + 1"),
             ("num_tasks", "count(*)")]
# one row per (stage, attempt): attempt comes from an array of attempts
STAGE_ROWS = [
    ("app_id", "'app-' || CAST(stage_id % 8 AS STRING)"), ("stage_id", "stage_id"), ("attempt", "attempt"),
    ("name", _pick("stage_id % 10", STAGE_NAMES)), ("num_tasks", "num_tasks"),
    ("parent_ids", "CASE WHEN stage_id >= 80 AND stage_id % 3 = 0 THEN ARRAY2(stage_id - 80, stage_id - 40) "
                   "WHEN stage_id >= 40 THEN ARRAY1(stage_id - 40) ELSE EMPTYLONGS() END"),
    ("submission_ms", "CASE WHEN attempt = 0 AND stage_id % 41 = 7 THEN NULL WHEN attempt = 0 THEN sub_ms ELSE comp_ms + 1000 END"),
    ("is_submitted", "NOT (attempt = 0 AND stage_id % 41 = 7)"), ("is_completed", "NOT (attempt = 0 AND stage_id % 37 = 5)"),
    ("completion_ms", "CASE WHEN attempt = 0 AND stage_id % 37 = 5 THEN NULL WHEN attempt = 0 THEN comp_ms "
                      "ELSE comp_ms + 60000 END"),
    ("failure_reason", "CASE WHEN attempt = 0 AND stage_id % 37 = 5 THEN NULL "
                       "WHEN stage_id % 29 = 0 AND attempt = 0 THEN 'FetchFailed: first attempt' "
                       "WHEN stage_id % 23 = 0 THEN " + _pick("stage_id % 7", STAGE_FAILURES) + " END"),
]
EXECUTOR_BASE = [("app_id", "'app-' || CAST(user_id % 8 AS STRING)"),
                 ("executor_id", "'exec-' || CAST(user_id DIV 8 AS STRING)"), ("user_id", "user_id"),
                 ("added_ms", "EPOCHMS(min(ts))"), ("last_ms", "EPOCHMS(max(ts))")]
REMOVED_REASON = _pick("(user_id DIV 3) % 6", REMOVALS)
ADDED_IF = "user_id % 21 <> 9"
REMOVED_IF = "user_id % 3 = 0"


def _dialect(sql: str, duck: bool) -> str:
    if duck:
        sql = sql.replace(" DIV ", " // ").replace("AS STRING)", "AS VARCHAR)")
        sql = re.sub(r"EPOCHMS\(((?:min|max)\(\w+\)|\w+)\)", r"(epoch_us(\1) // 1000)", sql)
        sql = re.sub(r"ARRAY[12]\(([^)]*)\)", r"[\1]", sql)
        return sql.replace("EMPTYLONGS()", "CAST([] AS BIGINT[])")
    sql = re.sub(r"ARRAY[12]\(", "array(", sql).replace("EMPTYLONGS()", "CAST(array() AS ARRAY<BIGINT>)")
    # days, hours and seconds of a TIMESTAMP_NTZ do not depend on the session time zone
    part = (r"(unix_date(CAST(\1 AS DATE))*86400000L + hour(\1)*3600000L + minute(\1)*60000L"
            r" + CAST(floor(extract(SECOND FROM \1)*1000) AS BIGINT))")
    return re.sub(r"EPOCHMS\(((?:min|max)\(\w+\)|\w+)\)", part, sql)


def cols(pairs, duck: bool = False) -> list[str]:
    return [f"{_dialect(e, duck)} AS {n}" for n, e in pairs]


SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tasks_from(lineitem: DataFrame, *keep: str) -> DataFrame:
    """The tasks of line items; columns in ``keep`` pass through, and take the place of task columns of the same name."""
    out = [c for (n, _), c in zip(TASK_3, cols(TASK_3)) if n not in keep]
    return lineitem.selectExpr(*cols(TASK_1), *keep).selectExpr("*", *cols(TASK_2)).selectExpr(*out, *keep)


#: The application of a line item, as in ``tasks_from``.
APP_OF_ITEM = f"'app-' || CAST({dict(TASK_1)['a']} AS STRING)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks_from(_read(spark, sf_dir, "lineitem"))


def task_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TaskStart rows: every task, and for one part in 89 a launch that never ended."""
    base = _read(spark, sf_dir, "lineitem").selectExpr(*cols(TASK_1), "explode(IF(l_partkey % 89 = 3, array(0L, 5L), array(0L))) AS shift")
    return base.selectExpr("'app-' || CAST(a AS STRING) AS app_id", "stage_id", "stage_attempt",
                           "task_id * 10 + shift AS task_key", "ship_ms + ln*1000 AS launch_ms", "executor_id")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (_read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 400).alias("stage_id"))
            .agg(*[F.expr(c.rsplit(" AS ", 1)[0]).alias(c.rsplit(" AS ", 1)[1]) for c in cols(STAGE_AGG)]))
    rows = base.selectExpr("*", "explode(IF(stage_id % 29 = 0, array(0L, 1L), array(0L))) AS attempt")
    out = rows.selectExpr(*cols(STAGE_ROWS))
    return out.selectExpr("*", "array('MapPartitionsRDD', split(name, ' ')[0]) AS rdd_names",
                          "CASE WHEN completion_ms IS NULL THEN 'SUBMITTED' WHEN failure_reason IS NOT NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = stages(spark, sf_dir).groupBy("app_id", "stage_id").agg(
        F.min("submission_ms").alias("sub"), F.max(F.coalesce("completion_ms", "submission_ms")).alias("comp"),
        F.max_by("status", "attempt").alias("st"))
    by_job = final.groupBy("app_id", (F.col("stage_id") % 40).alias("job_id")).agg(
        F.min("sub").alias("submission_ms"), (F.max("comp") + 10).alias("end_ms"),
        F.sort_array(F.collect_list("stage_id")).alias("stage_ids"), F.max((F.col("st") == "FAILED").cast("int")).alias("bad"))
    ended = F.col("job_id") % 13 != 6
    result = F.when(ended, F.when(F.col("bad") == 1, "JobFailed").otherwise("JobSucceeded"))
    status = F.when(~ended, "RUNNING").when(F.col("bad") == 1, "FAILED").otherwise("SUCCESS")
    return by_job.select("app_id", "job_id", "submission_ms", F.when(ended, F.col("end_ms")).alias("completion_ms"),
                         "stage_ids", result.alias("result"), status.alias("status"))


def _executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("mn"), F.max("ts").alias("mx"))
    pairs = [(n, e.replace("min(ts)", "mn").replace("max(ts)", "mx")) for n, e in EXECUTOR_BASE]
    return ev.selectExpr(*cols(pairs))


def executor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _executors(spark, sf_dir).selectExpr(
        "*", f"explode(filter(array(IF({ADDED_IF}, 'ADDED', NULL), IF({REMOVED_IF}, 'REMOVED', NULL)), x -> x IS NOT NULL)) AS kind")
    return kinds.selectExpr(
        "app_id", "executor_id", "kind", "IF(kind = 'ADDED', added_ms, added_ms + user_id*1000) AS ts_ms",
        "IF(kind = 'ADDED', 'host-' || CAST(user_id % 5 AS STRING), NULL) AS host", "IF(kind = 'ADDED', 4L, NULL) AS cores",
        f"IF(kind = 'REMOVED', {_dialect(REMOVED_REASON, False)}, NULL) AS reason")


def block_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executors(spark, sf_dir).selectExpr(
        "app_id", "executor_id", "'host-' || CAST(user_id % 5 AS STRING) AS host", "55000000L AS max_onheap",
        "(user_id % 4)*1000000 AS max_offheap", "added_ms + 100 AS added_ms",
        f"IF({REMOVED_IF}, added_ms + user_id*1000, NULL) AS removed_ms")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = _dialect("EPOCHMS(o_orderdate)", False)
    app = _read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 8).alias("a")).agg(
        F.expr(f"min({ms})").alias("start_ms"), F.expr(f"max({ms})").alias("end_ms"))
    return app.selectExpr("'app-' || CAST(a AS STRING) AS app_id", "'etl-' || CAST(a AS STRING) AS app_name",
                          "'user-' || CAST(a % 3 AS STRING) AS user", "'4.1.2' AS spark_version", "start_ms",
                          "IF(a = 7, NULL, end_ms) AS end_ms", "IF(a = 7, NULL, end_ms - start_ms) AS duration_ms")


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications(spark, sf_dir).selectExpr(
        "app_id", "map('spark.app.name', app_name, 'spark.executor.memory', CAST(4 + length(user) AS STRING) || 'g', "
        "'spark.sql.shuffle.partitions', '200') AS props")


# --- the same tables as DuckDB common table expressions ------------------------------------------
def duck_ctes() -> str:
    def sel(pairs, src):
        return "SELECT " + ", ".join(cols(pairs, True)) + " FROM " + src

    reason = _dialect(REMOVED_REASON, True)
    return f"""
t1 AS ({sel(TASK_1, "lineitem")}),
t2 AS (SELECT *, {", ".join(cols(TASK_2, True))} FROM t1),
tasks AS ({sel(TASK_3, "t2")}),
task_starts AS (SELECT 'app-' || CAST(a AS VARCHAR) AS app_id, stage_id, stage_attempt, task_id*10 + s.shift AS task_key,
  ship_ms + ln*1000 AS launch_ms, executor_id
  FROM t1, LATERAL (SELECT unnest(CASE WHEN pk % 89 = 3 THEN [0, 5] ELSE [0] END) AS shift) s),
s1 AS (SELECT o_orderkey % 400 AS stage_id, {", ".join(cols(STAGE_AGG, True))} FROM orders GROUP BY 1),
s2 AS (SELECT s1.*, CAST(x.attempt AS BIGINT) AS attempt FROM s1,
  LATERAL (SELECT unnest(CASE WHEN stage_id % 29 = 0 THEN [0, 1] ELSE [0] END) AS attempt) x),
s3 AS ({sel(STAGE_ROWS, "s2")}),
stages AS (SELECT *, CASE WHEN completion_ms IS NULL THEN 'SUBMITTED' WHEN failure_reason IS NOT NULL THEN 'FAILED'
  ELSE 'SUCCESS' END AS status FROM s3),
j1 AS (SELECT app_id, stage_id, min(submission_ms) AS sub, max(coalesce(completion_ms, submission_ms)) AS comp,
  arg_max(status, attempt) AS st FROM stages GROUP BY 1, 2),
j2 AS (SELECT app_id, stage_id % 40 AS job_id, min(sub) AS submission_ms, max(comp) + 10 AS end_ms,
  list_sort(list(stage_id)) AS stage_ids, max(CASE WHEN st = 'FAILED' THEN 1 ELSE 0 END) AS bad FROM j1 GROUP BY 1, 2),
jobs AS (SELECT app_id, job_id, submission_ms, CASE WHEN job_id % 13 <> 6 THEN end_ms END AS completion_ms, stage_ids,
  CASE WHEN job_id % 13 = 6 THEN NULL WHEN bad = 1 THEN 'JobFailed' ELSE 'JobSucceeded' END AS result,
  CASE WHEN job_id % 13 = 6 THEN 'RUNNING' WHEN bad = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM j2),
x1 AS (SELECT {", ".join(cols(EXECUTOR_BASE, True))} FROM events GROUP BY user_id),
executor_events AS (
  SELECT app_id, executor_id, 'ADDED' AS kind, added_ms AS ts_ms, 'host-' || CAST(user_id % 5 AS VARCHAR) AS host,
    CAST(4 AS BIGINT) AS cores, CAST(NULL AS VARCHAR) AS reason FROM x1 WHERE {ADDED_IF}
  UNION ALL SELECT app_id, executor_id, 'REMOVED', added_ms + user_id*1000, NULL, NULL, {reason} FROM x1 WHERE {REMOVED_IF}),
block_managers AS (SELECT app_id, executor_id, 'host-' || CAST(user_id % 5 AS VARCHAR) AS host, CAST(55000000 AS BIGINT) AS max_onheap,
  (user_id % 4)*1000000 AS max_offheap, added_ms + 100 AS added_ms,
  CASE WHEN {REMOVED_IF} THEN added_ms + user_id*1000 END AS removed_ms FROM x1),
applications AS (SELECT 'app-' || CAST(a AS VARCHAR) AS app_id, 'etl-' || CAST(a AS VARCHAR) AS app_name,
  'user-' || CAST(a % 3 AS VARCHAR) AS "user", '4.1.2' AS spark_version, start_ms,
  CASE WHEN a = 7 THEN NULL ELSE end_ms END AS end_ms, CASE WHEN a = 7 THEN NULL ELSE end_ms - start_ms END AS duration_ms
  FROM (SELECT o_orderkey % 8 AS a, min(epoch_ms(o_orderdate)) AS start_ms, max(epoch_ms(o_orderdate)) AS end_ms
        FROM orders GROUP BY 1))"""


class BenchCorpus:
    """The canonical tables of one driver directory, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    tasks = cached_property(lambda self: tasks(self.spark, self.sf_dir))
    task_starts = cached_property(lambda self: task_starts(self.spark, self.sf_dir))
    stages = cached_property(lambda self: stages(self.spark, self.sf_dir))
    jobs = cached_property(lambda self: jobs(self.spark, self.sf_dir))
    executor_events = cached_property(lambda self: executor_events(self.spark, self.sf_dir))
    block_managers = cached_property(lambda self: block_managers(self.spark, self.sf_dir))
    applications = cached_property(lambda self: applications(self.spark, self.sf_dir))
    environment = cached_property(lambda self: environment(self.spark, self.sf_dir))
    task_parts = cached_property(lambda self: stash(parts.task_parts(self.tasks)))
    duration_counts = cached_property(lambda self: metrics.duration_counts(self.tasks))
