"""Event-log text derived from the driver tables: the input of source and parser queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.bench import views as v
from eventlens.plans.stash import new_path, setting, stash

#: Rows read in a row that share a file of each application's log.
FILE_ROWS = 400_000
#: The folder that Spark gives to rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: While text is made: the code for the some sixty fields of a task in one method would be longer than the JVM compiles, and four times as slow.
SHORT_METHODS = ("spark.sql.codegen.hugeMethodLimit", "8000")

# Half of the tasks keep their figures in 'Task Metrics', half in 'Task Executor Metrics'.
_METRICS = """named_struct('Executor Run Time', run_ms, 'Executor CPU Time', cpu_ns, 'Executor Deserialize Time', deser_ms, 'JVM GC Time', gc_ms,
  'MinorGCTime', minor_gc_ms, 'MajorGCTime', major_gc_ms, 'JVMHeapMemory', heap_bytes, 'JVMOffHeapMemory', offheap_bytes, 'Result Size', result_bytes,
  'Memory Bytes Spilled', IF(task_id % 4 < 2, mem_spill_bytes, NULL), 'Memory Spill Metrics', IF(task_id % 4 < 2, NULL, named_struct('Spilled Bytes', mem_spill_bytes)),
  'Disk Bytes Spilled', disk_spill_bytes,
  'Shuffle Read Metrics', CASE WHEN task_id % 3 = 0 THEN named_struct('Total Bytes Read', sh_read_bytes, 'Remote Bytes Read', NULL, 'Local Bytes Read', NULL, 'Fetch Wait Time', fetch_wait_ms)
    ELSE named_struct('Total Bytes Read', NULL, 'Remote Bytes Read', sh_read_bytes div 3, 'Local Bytes Read', sh_read_bytes - sh_read_bytes div 3, 'Fetch Wait Time', fetch_wait_ms) END,
  'Shuffle Write Metrics', named_struct('Shuffle Bytes Written', sh_write_bytes, 'Shuffle Write Time', sh_write_time, 'Shuffle Records Written', sh_write_records),
  'Input Metrics', named_struct('Bytes Read', in_bytes, 'Records Read', in_records),
  'Output Metrics', IF(out_bytes > 0, named_struct('Bytes Written', out_bytes, 'Records Written', out_records), NULL))"""


def _line(df: DataFrame, order: int, body: str, *keep: str) -> DataFrame:
    return df.selectExpr("app_id", f"{order} AS ord", f"to_json({body}) AS value", *keep)


def _task_lines(items: DataFrame, *keep: str) -> DataFrame:
    """The task ends of line items; columns in ``keep`` pass through."""
    return _line(v.tasks_from(items, "message", *keep), 5, f"""named_struct('Event', 'SparkListenerTaskEnd', 'Stage ID', stage_id, 'Stage Attempt ID', stage_attempt, 'Task Type', 'ResultTask',
      'Task End Reason', named_struct('Reason', IF(message IS NULL, 'Success', end_reason), 'Message', message),
      'Task Info', named_struct('Task ID', task_id, 'Attempt', attempt, 'Launch Time', launch_ms, 'Finish Time', finish_ms, 'Executor ID', executor_id, 'Host', host,
        'Locality', locality, 'Speculative', speculative),
      'Task Metrics', IF(task_id % 2 = 0, {_METRICS}, NULL), 'Task Executor Metrics', IF(task_id % 2 = 0, NULL, {_METRICS}))""", *[k for k in keep if k != "app_id"])


def task_lines(s: SparkSession, d: str) -> DataFrame:
    return _task_lines(v._read(s, d, "lineitem"))


def stage_lines(s: SparkSession, d: str) -> DataFrame:
    st = v.stages(s, d)
    info = ("named_struct('Stage ID', stage_id, 'Stage Attempt ID', attempt, 'Stage Name', IF(stage_id % 2 = 0, name, NULL), 'Name', IF(stage_id % 2 = 1, name, NULL), "
            "'Number of Tasks', num_tasks, 'Parent IDs', parent_ids, 'RDD Info', transform(rdd_names, r -> named_struct('Name', r)), {0})")
    sub = _line(st.filter("is_submitted"), 3, f"named_struct('Event', 'SparkListenerStageSubmitted', 'Stage Info', {info.format(chr(39) + 'Submission Time' + chr(39) + ', submission_ms')})")
    done = _line(st.filter("is_completed"), 6, f"named_struct('Event', 'SparkListenerStageCompleted', 'Stage Info', "
                 + info.format("'Completion Time', completion_ms, 'Failure Reason', failure_reason") + ")")
    return sub.unionAll(done)


def job_lines(s: SparkSession, d: str) -> DataFrame:
    j = v.jobs(s, d)
    start = _line(j, 2, """named_struct('Event', 'SparkListenerJobStart', 'Job ID', job_id, 'Submission Time', submission_ms, 'Stage IDs', IF(job_id % 2 = 0, stage_ids, NULL),
      'Stage Infos', IF(job_id % 2 = 0, NULL, transform(stage_ids, x -> named_struct('Stage ID', x))))""")
    end = _line(j.filter("result IS NOT NULL"), 7, """named_struct('Event', 'SparkListenerJobEnd', 'Job ID', job_id, 'Completion Time', completion_ms,
      'Job Result', named_struct('Result', result))""")
    return start.unionAll(end)


def executor_lines(s: SparkSession, d: str) -> DataFrame:
    """Additions carry ``Timestamp`` or ``Time`` by turns."""
    e = v.executor_events(s, d)
    t = "'Timestamp', IF(ts_ms % 2 = 0, ts_ms, NULL), 'Time', IF(ts_ms % 2 = 0, NULL, ts_ms)"
    added = _line(e.filter("kind = 'ADDED'"), 1, f"named_struct('Event', 'SparkListenerExecutorAdded', {t}, 'Executor ID', executor_id, 'Executor Info', named_struct('Host', host, 'Total Cores', cores))")
    gone = _line(e.filter("kind = 'REMOVED'"), 8, f"named_struct('Event', 'SparkListenerExecutorRemoved', {t}, 'Executor ID', executor_id, 'Removed Reason', reason)")
    return added.unionAll(gone)


def block_lines(s: SparkSession, d: str) -> DataFrame:
    b = v.block_managers(s, d)
    box = "'Block Manager ID', named_struct('Executor ID', executor_id, 'Host', host, 'Port', 7079)"
    up = _line(b, 1, f"named_struct('Event', 'SparkListenerBlockManagerAdded', 'Timestamp', added_ms, {box}, 'Maximum OnHeap Memory', max_onheap, 'Maximum OffHeap Memory', max_offheap)")
    down = _line(b.filter("removed_ms IS NOT NULL"), 8, f"named_struct('Event', 'SparkListenerBlockManagerRemoved', 'Timestamp', removed_ms, {box})")
    return up.unionAll(down)


def app_lines(s: SparkSession, d: str) -> DataFrame:
    a = v.applications(s, d)
    start = _line(a, 0, """named_struct('Event', 'SparkListenerApplicationStart', 'App Name', app_name, 'App ID', app_id, 'Timestamp', start_ms, 'User', user, 'Spark Version', spark_version)""")
    end = _line(a.filter("end_ms IS NOT NULL"), 9, "named_struct('Event', 'SparkListenerApplicationEnd', 'Timestamp', end_ms)")
    env = _line(v.environment(s, d), 1, "named_struct('Event', 'SparkListenerEnvironmentUpdate', 'Spark Properties', props)")
    return start.unionAll(end).unionAll(env)


def start_lines(s: SparkSession, d: str) -> DataFrame:
    return _line(v.task_starts(s, d), 4, """named_struct('Event', 'SparkListenerTaskStart', 'Stage ID', stage_id, 'Stage Attempt ID', stage_attempt,
      'Task Info', named_struct('Task ID', task_key, 'Launch Time', launch_ms, 'Executor ID', executor_id))""")


def noise_lines(s: SparkSession, d: str) -> DataFrame:
    """Blank lines, cut-off lines and records without a discriminator, by order key."""
    orders = v._read(s, d, "orders")
    return orders.selectExpr("concat('app-', o_orderkey % 8) AS app_id", "5 AS ord", """CASE WHEN o_orderkey % 97 = 5 THEN '{"Event": "SparkListenerTaskEnd", "Stage'
        WHEN o_orderkey % 89 = 3 THEN concat('{"Timestamp": ', o_orderkey, ', "note": "no discriminator"}') WHEN o_orderkey % 101 = 7 THEN '   ' END AS value""").filter("value IS NOT NULL")


def other_lines(s: SparkSession, d: str) -> DataFrame:
    """(app_id, ord, value): every well-formed event but the task ends."""
    parts = [app_lines, executor_lines, block_lines, job_lines, stage_lines]
    out = parts[0](s, d)
    for p in parts[1:]:
        out = out.unionAll(p(s, d))
    return out


def event_lines(s: SparkSession, d: str) -> DataFrame:
    """(app_id, ord, value): every well-formed event as JSON text."""
    return other_lines(s, d).unionAll(task_lines(s, d))


def noisy_lines(s: SparkSession, d: str) -> DataFrame:
    return event_lines(s, d).unionAll(noise_lines(s, d))


def _rolled(rows: DataFrame, kind: str, order: str = "place") -> DataFrame:
    """Rows with the ``folder`` of their application, ``roll``, the file of its log, and whether they are its ``first`` and ``last``, in the order of the files.

    A file holds an application's part of ``FILE_ROWS`` rows that come one after another, so its size is bounded however
    many rows an application has. The rows are sorted by folder and file, neither of them null, while they are still short: so
    ``_write`` finds its order and does not sort their text.
    """
    place = rows.withColumn("place", F.monotonically_increasing_id())
    roll = f"concat('{kind}-', place >> 33, '-', (place & {(1 << 33) - 1}) div {FILE_ROWS})"
    file = Window.partitionBy("folder", "roll").orderBy(*order.split(", "))
    named = place.withColumn("folder", F.expr(f"coalesce(app_id, '{NO_VALUE}')")).withColumn("roll", F.expr(f"coalesce({roll}, '')"))
    return named.repartition("folder", "roll").select(
        "*", F.lag(F.lit(1)).over(file).isNull().alias("first"), F.lead(F.lit(1)).over(file).isNull().alias("last")).sortWithinPartitions("folder", "roll", *order.split(", "))


def _array(lines: DataFrame, where: str) -> DataFrame:
    """The lines of the applications ``where`` as those of one JSON array per file."""
    return lines.withColumn("value", F.expr(f"IF({where}, concat(IF(first, '[\n', ','), value, IF(last, '\n]', '')), value)"))


def _write(lines: DataFrame, path: str, compression: str) -> None:
    """Rolling logs: a folder per application, in which each file has a folder of its own."""
    files = lines.select(F.col("folder").alias("eventlog_v2_app_id"), "roll", "value")
    with setting(lines.sparkSession, *SHORT_METHODS):
        files.write.mode("append").partitionBy("eventlog_v2_app_id", "roll").option("compression", compression).text(path)


def stored(lines: DataFrame) -> DataFrame:
    """Event text as a stored table, so that parsing starts from text as it does for log files."""
    with setting(lines.sparkSession, *SHORT_METHODS):
        return stash(lines.select("app_id", "value"))


def write_events(s: SparkSession, d: str, path: str, noise: bool = False, arrays: str = "false", only: str = "true", compression: str = "gzip") -> str:
    """The events of the applications ``only``, with the noise or without, as rolling logs below ``path``; those of the applications ``arrays`` as JSON arrays.

    Line items are spread over the files before they become text, which is some twenty times as large and is written once.
    """
    keep = ("app_id", "folder", "roll", "first", "last")
    items = v._read(s, d, "lineitem").withColumn("app_id", F.expr(v.APP_OF_ITEM)).filter(only)
    _write(_array(_task_lines(_rolled(items, "tasks"), *keep), arrays), path, compression)
    others = other_lines(s, d).unionAll(noise_lines(s, d)) if noise else other_lines(s, d)
    _write(_array(_rolled(stash(others.filter(only)), "others", "ord, place"), arrays), path, compression)
    return path


def write_ndjson(s: SparkSession, d: str) -> str:
    return write_events(s, d, new_path(s, "ndjson"), noise=True)


def write_arrays(s: SparkSession, d: str) -> str:
    return write_events(s, d, new_path(s, "arrays"), arrays="true")


def write_mixed(s: SparkSession, d: str) -> str:
    """Applications 0 to 3 as arrays, the others as lines; events without an application are left out."""
    return write_events(s, d, new_path(s, "mixed"), arrays="app_id < 'app-4'", only="app_id IS NOT NULL")


def write_summaries(s: SparkSession, d: str) -> str:
    """One summarised log per application; a stage list has some fifty entries."""
    st = v.tasks(s, d).groupBy("app_id", "stage_id").agg({"run_ms": "sum", "gc_ms": "sum", "mem_spill_bytes": "sum", "disk_spill_bytes": "sum", "duration_ms": "sum", "task_id": "count"})
    rows = st.selectExpr("app_id", """named_struct('stageId', stage_id, 'name', concat('stage ', stage_id), 'numTasks', `count(task_id)`, 'executorRunTime', `sum(run_ms)`,
      'gcTime', `sum(gc_ms)`, 'memoryBytesSpilled', `sum(mem_spill_bytes)`, 'diskBytesSpilled', `sum(disk_spill_bytes)`,
      'taskMetrics', named_struct('avgCpuUtilization', 0.5D, 'avgTaskDurationMs', `sum(duration_ms)` div `count(task_id)`)) AS s""")
    logs = rows.groupBy("app_id").agg({"s": "collect_list"}).selectExpr("app_id", "0 AS ord", "to_json(named_struct('applicationId', app_id, 'stages', `collect_list(s)`)) AS value")
    path = new_path(s, "summaries")
    logs.repartition("app_id").select("app_id", "value").write.partitionBy("app_id").text(path)
    return path
