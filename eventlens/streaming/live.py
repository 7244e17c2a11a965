"""Structured Streaming over logs that still grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.text import ratio
from eventlens.plans.stash import setting
from eventlens.schema import event_schema
from eventlens.sources.normalize import typed
from eventlens.sources.sinks import OPEN_FILES


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Typed events of line-delimited logs under ``path`` as a stream (an array cannot be tailed)."""
    reader = spark.readStream.schema(event_schema()).option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed(reader.json(path).select("*", F.col("_metadata.file_path").alias("file")))


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str) -> None:
    """Append everything new under ``path`` to ``store`` (Parquet by event type) and stop; rerun or schedule to follow the logs.

    The checkpoint records which files are done, so a lost executor or a restart neither drops nor repeats events.
    """
    events = stream_events(spark, path).withColumnRenamed("Event", "event_type")
    with setting(spark, *OPEN_FILES):
        query = (events.writeStream.format("parquet").partitionBy("event_type").option("path", store).option("compression", "zstd")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def task_windows(tasks: DataFrame, every: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Task count, durations, CPU efficiency and GC share per application and window of finish time.

    The same definition serves a stream and a table; on a stream, state is one small row per open window.
    """
    timed = tasks.withColumn("finished", F.expr("timestamp_millis(finish_ms)")).withWatermark("finished", late)
    out = timed.groupBy("app_id", F.window("finished", every, slide)).agg(
        F.expr("count(1) AS tasks"), F.expr("avg(duration_ms) AS mean_duration_ms"), F.expr("max(duration_ms) AS max_duration_ms"),
        F.expr("sum(CAST(cpu_ns AS DOUBLE)) / 1e6D AS cpu_ms"), F.expr("sum(run_ms) AS run_ms"), F.expr("sum(gc_ms) AS gc_ms"))
    return out.selectExpr("app_id", "unix_millis(window.start) AS window_start_ms", "unix_millis(window.end) AS window_end_ms", "tasks", "mean_duration_ms", "max_duration_ms",
                          f"{ratio('cpu_ms', 'run_ms')} AS cpu_efficiency", f"{ratio('gc_ms', 'run_ms')} AS gc_overhead_ratio")


def run_updates(windows: DataFrame, store: str, checkpoint: str) -> None:
    """Write every changed window of each micro-batch to ``store``; see ``latest``."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    query = windows.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, store: str, keys: tuple[str, ...] = ("app_id", "window_start_ms", "window_end_ms")) -> DataFrame:
    """The newest version of each window."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(store)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.expr(f"max_by(struct({', '.join(rest)}), batch_id) AS r")).select(*keys, "r.*").drop("batch_id")


def executor_loss(executor_events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Removed executors and heartbeat timeouts per application and window."""
    timed = executor_events.filter("kind = 'REMOVED'").withColumn("at", F.expr("timestamp_millis(ts_ms)")).withWatermark("at", late)
    out = timed.groupBy("app_id", F.window("at", every)).agg(
        F.expr("count(1) AS removed"), F.expr("count_if(contains(lower(reason), 'heartbeat')) AS heartbeat_timeouts"))
    return out.selectExpr("app_id", "unix_millis(window.start) AS window_start_ms", "unix_millis(window.end) AS window_end_ms", "removed", "heartbeat_timeouts")


def run_append(windows: DataFrame, store: str, checkpoint: str) -> None:
    """Write each window once, when the watermark has passed its end; events later than that are dropped."""
    query = windows.writeStream.outputMode("append").format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: What a window keeps of its tasks, so that those of several micro-batches can be put together: name -> (expression, how).
_PARTIAL = {"tasks": ("count(1)", "sum"), "sum_duration_ms": ("sum(duration_ms)", "sum"), "max_duration_ms": ("max(duration_ms)", "max"), "cpu_ms": ("sum(CAST(cpu_ns AS DOUBLE)) / 1e6D", "sum"),
            "run_ms": ("sum(run_ms)", "sum"), "gc_ms": ("sum(gc_ms)", "sum")}
_PROGRESS = "latest_ms LONG, rows LONG, late_rows LONG, batch LONG"


def run_counted(tasks: DataFrame, store: str, checkpoint: str, every_ms: int, late_ms: int) -> None:
    """Windows of a stream of tasks in which nothing vanishes.

    Every micro-batch adds its own figures of each window to ``parts``. Rows whose window had been closed before the batch (its
    end lies ``late_ms`` or more before the latest finish time of earlier batches) go to ``late`` instead, and their number to
    ``progress``; all three are taken from the batch's ``windows``, its figures by window and lateness. All are written by batch
    number, so a batch that is run again replaces itself.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = None
        if batch_id:
            latest = spark.read.schema(_PROGRESS).parquet(f"{store}/progress").filter(F.col("batch") < batch_id).agg(F.max("latest_ms")).first()[0]
        closed = "false" if latest is None else f"coalesce(window_start_ms + {every_ms} <= {latest - late_ms}, false)"
        # one pass over the batch; what is kept of it has a row or two per window
        found = batch.selectExpr("*", f"finish_ms div {every_ms} * {every_ms} AS window_start_ms").groupBy("app_id", "window_start_ms", F.expr(closed).alias("is_late")).agg(
            F.max("finish_ms").alias("latest_ms"), *[F.expr(e).alias(n) for n, (e, _) in _PARTIAL.items()])
        found.coalesce(8).write.mode("overwrite").parquet(f"{store}/windows/batch={batch_id}")
        windows = spark.read.schema(found.schema).parquet(f"{store}/windows/batch={batch_id}")
        for name, side in (("parts", "NOT is_late"), ("late", "is_late")):
            windows.filter(side).drop("is_late", "latest_ms").write.mode("overwrite").parquet(f"{store}/{name}/batch={batch_id}")
        windows.agg(F.max("latest_ms").alias("latest_ms"), F.expr("coalesce(sum(tasks), 0) AS rows"), F.expr("coalesce(sum(tasks) FILTER (WHERE is_late), 0) AS late_rows")).write.mode("overwrite").parquet(f"{store}/progress/batch={batch_id}")

    tasks.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_windows(spark: SparkSession, store: str, every_ms: int, late: bool = True) -> DataFrame:
    """The windows of ``run_counted`` so far, with or without the late rows; the last ones too, so a finished log needs no further event."""
    rows = spark.read.parquet(f"{store}/parts")
    if late:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{store}/late"))
    out = rows.groupBy("app_id", "window_start_ms").agg(*[F.expr(f"{how}({n}) AS {n}") for n, (_, how) in _PARTIAL.items()])
    return out.selectExpr("app_id", "window_start_ms", f"window_start_ms + {every_ms} AS window_end_ms", "tasks", f"{ratio('sum_duration_ms', 'tasks')} AS mean_duration_ms", "max_duration_ms",
                          f"{ratio('cpu_ms', 'run_ms')} AS cpu_efficiency", f"{ratio('gc_ms', 'run_ms')} AS gc_overhead_ratio")


def counted_progress(spark: SparkSession, store: str) -> DataFrame:
    """(batch, latest_ms, rows, late_rows) of every micro-batch."""
    return spark.read.schema(_PROGRESS).parquet(f"{store}/progress")
