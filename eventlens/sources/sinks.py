"""Writing events and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventlens.plans.stash import setting

#: Files that a task writes at a time without sorting its records, which are wide, by folder; it does sort what has more folders.
OPEN_FILES = ("spark.sql.maxConcurrentOutputFileWriters", "32")


def write_events_json(events: DataFrame, path: str) -> None:
    """Parsed events as gzip-compressed JSON lines, one folder per application; the tasks' parts are files of their own."""
    with setting(events.sparkSession, *OPEN_FILES):
        events.drop("_corrupt_record", "raw", "file").write.partitionBy("app_id").json(path, compression="gzip")


def write_events_parquet(events: DataFrame, path: str) -> None:
    """Parsed events by event type, so every canonical table reads only its own files."""
    with setting(events.sparkSession, *OPEN_FILES):
        events.withColumnRenamed("Event", "event_type").write.partitionBy("event_type").parquet(path, compression="zstd")


def write_report_json(documents: DataFrame, path: str) -> None:
    """One JSON document per application, one folder each."""
    documents.select("app_id", "document").write.partitionBy("app_id").text(path)


def write_report_text(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per application, in report order.

    A report has some hundred lines, so keeping an application's lines in one task is safe.
    """
    order = [c for c in ("section_no", "item_no", "chain_no", "line_no") if c in lines.columns]
    lines.repartition("app_id").sortWithinPartitions("app_id", *order).select("app_id", "line").write.partitionBy("app_id").text(path)
