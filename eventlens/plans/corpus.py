"""A corpus of event logs as canonical tables, and the whole diagnosis over it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import causes, detectors, executors, failures, metrics, parts, stages
from eventlens.plans import report
from eventlens.plans.stash import new_path, stash
from eventlens.schema import CORRUPT
from eventlens.sources import readers, sinks, tables
from eventlens.sources.normalize import checked, parse_stats, record_counts


class Corpus:
    """Canonical tables of all applications; each is built on first use."""

    def __init__(self, records: DataFrame, load_counts: dict[str, int] | None = None):
        self.records, self.load_counts = records, load_counts
        self.events = records.filter("Event IS NOT NULL")

    @classmethod
    def load(cls, spark: SparkSession, path: str, store: str | None = None, strict: bool = False, peek: bool = True) -> "Corpus":
        """Parse the logs under ``path`` once into ``store`` (Parquet by event type, default in the shared folder).

        All tables then read only the files and columns they need. Every record is stored with its text (``raw``), so
        fields outside the schema stay readable; records that are not events are found in ``rejected``. ``strict``
        stops at the first record that is not valid. ``peek=False`` is for stores that only Spark can open. ``load_counts``
        has the totals of ``parse_stats`` over all records, taken while they were written.
        """
        store = store or new_path(spark, "events")
        records = checked(readers.parse_lines(readers.scan_records(spark, path, peek)), strict)
        counted = Observation()
        sinks.write_events_parquet(records.observe(counted, *[F.expr(e).alias(n) for n, e in record_counts().items()]), store)
        stored = records.withColumnRenamed("Event", "event_type").schema
        parsed = spark.read.schema(stored).parquet(store).withColumnRenamed("event_type", "Event")
        return cls(tables.attach_app_ids(parsed, stash(tables.log_ids(parsed))), dict(counted.get))

    @cached_property
    def rejected(self) -> DataFrame:
        """(app_id, file, raw, reason) of records that are not events: not JSON, or without a discriminator."""
        return self.records.filter("Event IS NULL").selectExpr("app_id", "file", "raw", f"IF({CORRUPT} IS NULL, 'no event name', 'malformed') AS reason")

    @cached_property
    def parse_statistics(self) -> DataFrame:
        """Totals per application of the load, from the stored records."""
        return parse_stats(self.records)

    tasks = cached_property(lambda self: tables.tasks(self.events))
    task_starts = cached_property(lambda self: tables.task_starts(self.events))
    stages = cached_property(lambda self: tables.stages(self.events))
    jobs = cached_property(lambda self: tables.jobs(self.events))
    executor_events = cached_property(lambda self: tables.executor_events(self.events))
    block_managers = cached_property(lambda self: tables.block_managers(self.events))
    applications = cached_property(lambda self: tables.applications(self.events))
    environment = cached_property(lambda self: tables.environment(self.events))
    raw_events = cached_property(lambda self: tables.raw_events(self.events))
    #: What most results need of the tasks, written once each: mergeable parts, and how often each duration comes.
    task_parts = cached_property(lambda self: stash(parts.task_parts(self.tasks)))
    duration_counts = cached_property(lambda self: metrics.duration_counts(self.tasks))


class Diagnosis:
    """The result tables over a corpus.

    ``metrics``, ``failure_counts``, ``stage_details``, the summary and the causes feed most results; they have a few rows per application or
    stage and are written once to the shared folder. They follow from the corpus's task parts and duration counts, so all of
    them together take two passes over the tasks.
    """

    def __init__(self, corpus):
        self.corpus = corpus

    metrics = cached_property(lambda self: stash(metrics.app_metrics(self.corpus)))
    failure_counts = cached_property(lambda self: stash(failures.failure_counts(self.corpus.tasks, self.corpus.stages, self.corpus.executor_events, self.corpus.task_parts)))
    stage_details = cached_property(lambda self: stash(stages.stage_details(self.corpus.stages, self.corpus.tasks, self.corpus.task_parts)))
    _causes = cached_property(lambda self: stash(causes.all_root_causes(self.metrics)))
    _summary = cached_property(lambda self: stash(report.executive_summary(detectors.finding_arrays(self.metrics), self.failure_counts)))
    executor_stats = cached_property(lambda self: stash(executors.executor_stats(self.corpus.executor_events, self.corpus.tasks, self.corpus.task_parts)))

    def findings(self) -> DataFrame:
        return detectors.ranked(detectors.bottlenecks(self.metrics))

    def anomalies(self) -> DataFrame:
        return detectors.anomalies(self.metrics)

    def warnings(self) -> DataFrame:
        return detectors.warnings(self.metrics)

    def root_causes(self) -> DataFrame:
        return self._causes

    def hotspots(self) -> DataFrame:
        return detectors.task_hotspots(self.corpus.tasks, self.metrics)

    def executor_anomalies(self) -> DataFrame:
        return executors.executor_anomalies(self.executor_stats)

    def chains(self, within_ms: int | None = None) -> DataFrame:
        near = causes.nearby_executor_failures(self.stage_details, self.corpus.executor_events, within_ms) if within_ms else None
        return causes.cause_chains(self.stage_details, self.failure_counts, self.metrics, near)

    def summary(self) -> DataFrame:
        return self._summary

    def documents(self) -> DataFrame:
        return report.report_document(self.summary())

    def report_lines(self) -> DataFrame:
        return report.report_lines(self.summary(), self.root_causes())

    def stage_job_report(self) -> DataFrame:
        d = self.stage_details
        return report.stage_job_report(stages.stage_summary(d), stages.job_summary(self.corpus.jobs), stages.problem_transformations(d), stages.stage_hotspots(d))

    def write(self, path: str) -> None:
        """Documents, readable report and cause chains of every application under ``path``."""
        sinks.write_report_json(self.documents(), f"{path}/documents")
        sinks.write_report_text(self.report_lines(), f"{path}/report")
        sinks.write_report_text(report.text_summary_lines(self.summary()), f"{path}/summary")
        sinks.write_report_text(causes.chain_report_lines(causes.explore_failures(self.chains())), f"{path}/chains")
