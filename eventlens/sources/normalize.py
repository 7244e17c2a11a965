"""Validation and normalisation of parsed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import lit, ratio
from eventlens.schema import CORRUPT, REQUIRED

_METRIC_PARTS = ("Shuffle Read Metrics", "Shuffle Write Metrics", "Input Metrics", "Output Metrics")


def normalize_time(events: DataFrame) -> DataFrame:
    """``Timestamp`` falls back to ``Time``; ``ts_ms`` further to the submission or completion time."""
    return events.withColumn("Timestamp", F.expr("coalesce(Timestamp, Time)")).withColumn(
        "ts_ms", F.expr("coalesce(Timestamp, `Submission Time`, `Completion Time`, `Stage Info`.`Submission Time`, `Stage Info`.`Completion Time`, "
                        "`Task Info`.`Finish Time`, `Task Info`.`Launch Time`)"))


def validity() -> str:
    """True when a typed event carries its required fields with the right types; unknown types are always valid."""
    arms = " ".join(f"WHEN '{e}' THEN " + " AND ".join(f"`{f}` IS NOT NULL" for f in fields) for e, fields in REQUIRED.items())
    return f"{CORRUPT} IS NULL AND coalesce(CASE Event {arms} ELSE true END, false)"


def checked(events: DataFrame, strict: bool = False) -> DataFrame:
    """All records with ``is_valid``; in strict mode the first that is not valid, whatever is wrong with it, stops the job."""
    bad = f"raise_error(concat('invalid event: ', coalesce(Event, {CORRUPT}, 'record without Event')))" if strict else "false"
    return normalize_time(events).withColumn("is_valid", F.expr(f"CASE WHEN Event IS NOT NULL AND {validity()} THEN true ELSE {bad} END"))


def typed(events: DataFrame) -> DataFrame:
    """Events with ``is_valid``; records without a discriminator or that are not JSON are left out (see ``parse_stats``)."""
    return normalize_time(events).filter("Event IS NOT NULL").withColumn("is_valid", F.expr(validity()))


def untyped(events: DataFrame) -> DataFrame:
    """Events that fail validation: kept, but to be read from their text (``raw``)."""
    return typed(events).filter("NOT is_valid")


def strict(events: DataFrame) -> DataFrame:
    """Like ``typed`` but the first invalid event stops the job."""
    checked = normalize_time(events).filter("Event IS NOT NULL")
    fail = f"CASE WHEN {validity()} THEN true ELSE raise_error(concat('invalid event: ', Event)) END"
    return checked.withColumn("is_valid", F.expr(fail))


def missing_event(events: DataFrame) -> DataFrame:
    """JSON records without a discriminator."""
    return events.filter(f"Event IS NULL AND {CORRUPT} IS NULL")


def malformed(events: DataFrame) -> DataFrame:
    """Records that are not JSON."""
    return events.filter(f"Event IS NULL AND {CORRUPT} IS NOT NULL")


def open_field(path: str, kind: str = "string", text: str = "raw") -> str:
    """A field that the schema does not list, by its path in the text; NULL when absent or of another type."""
    return f"try_variant_get(try_parse_json({text}), {lit(path)}, '{kind}')"


def event_filter(events: DataFrame, *names: str) -> DataFrame:
    return events.filter(F.col("Event").isin(*names))


def event_counts(events: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Events per type."""
    return events.filter("Event IS NOT NULL").groupBy(*keys, "Event").count()


def record_counts() -> dict[str, str]:
    """The counts of ``parse_stats``: name -> expression over records with normalised time."""
    valid = validity()
    return {"total_records": "count(1)", "parsed_events": f"count_if(Event IS NOT NULL AND ({valid}))", "kept_untyped": f"count_if(Event IS NOT NULL AND NOT ({valid}))",
            "missing_event": f"count_if(Event IS NULL AND {CORRUPT} IS NULL)", "malformed": f"count_if(Event IS NULL AND {CORRUPT} IS NOT NULL)"}


def parse_stats(events: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Totals: records, valid events, events kept untyped, records without discriminator, malformed records, success rate."""
    out = normalize_time(events).groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in record_counts().items()])
    return out.selectExpr("*", "kept_untyped + missing_event + malformed AS failed_events", ratio("parsed_events", "total_records") + " AS success_rate")


def normalize_task_metrics(events: DataFrame) -> DataFrame:
    """Both metric containers with all four nested records present (empty where the log has none).

    A missing container stays missing, so validation still sees it.
    """
    out = events
    for box in ("Task Metrics", "Task Executor Metrics"):
        c = F.col(f"`{box}`")
        filled = c
        for part in _METRIC_PARTS:
            kind = events.schema[box].dataType[part].dataType
            empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
            filled = filled.withField(f"`{part}`", F.coalesce(c[part], empty))
        out = out.withColumn(box, F.when(c.isNotNull(), filled))
    return out
