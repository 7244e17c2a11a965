"""Registry of source, sink and parser queries."""

from pyspark.sql import functions as F

from eventlens.bench import logs
from eventlens.bench.reg_report import DOC_SQL, _lines, summary
from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, query, r6
from eventlens.bench.views import TASK_3, BenchCorpus
from eventlens.operators import metrics as M
from eventlens.plans import report as R
from eventlens.plans.corpus import Corpus
from eventlens.plans.stash import new_path, stash
from eventlens.sources import normalize as N
from eventlens.sources import readers, sinks, tables

NOISE_CTE = """
no AS (SELECT 'app-' || (o_orderkey % 8) AS app_id, CASE WHEN o_orderkey % 97 = 5 THEN 'malformed' WHEN o_orderkey % 89 = 3 THEN 'missing' WHEN o_orderkey % 101 = 7 THEN 'blank' END AS kind,
    o_orderkey FROM orders),
ev AS (
    SELECT app_id, 'SparkListenerTaskEnd' AS event, task_id % 2 = 1 AS ok FROM tasks
    UNION ALL SELECT app_id, 'SparkListenerStageSubmitted', true FROM stages WHERE is_submitted
    UNION ALL SELECT app_id, 'SparkListenerStageCompleted', true FROM stages WHERE is_completed
    UNION ALL SELECT app_id, 'SparkListenerJobStart', true FROM jobs
    UNION ALL SELECT app_id, 'SparkListenerJobEnd', true FROM jobs WHERE result IS NOT NULL
    UNION ALL SELECT app_id, CASE kind WHEN 'ADDED' THEN 'SparkListenerExecutorAdded' ELSE 'SparkListenerExecutorRemoved' END, true FROM executor_events
    UNION ALL SELECT app_id, 'SparkListenerBlockManagerAdded', true FROM block_managers
    UNION ALL SELECT app_id, 'SparkListenerBlockManagerRemoved', true FROM block_managers WHERE removed_ms IS NOT NULL
    UNION ALL SELECT app_id, 'SparkListenerApplicationStart', true FROM applications
    UNION ALL SELECT app_id, 'SparkListenerApplicationEnd', true FROM applications WHERE end_ms IS NOT NULL
    UNION ALL SELECT app_id, 'SparkListenerEnvironmentUpdate', true FROM applications)"""


def nq(sql: str, *extra: str) -> str:
    return query(sql, NOISE_CTE, *extra)


def _digest(events):
    """Per application: events, tasks and sums over the canonical tasks read from the log."""
    ev = tables.attach_app_ids(events)
    counts = ev.groupBy("app_id").agg(F.expr("count(Event) AS events"))
    t = tables.tasks(ev).groupBy("app_id").agg(*[F.expr(f"sum({c}) AS {c}") for c in _SUMS], F.expr("count(1) AS tasks"))
    return counts.join(t, "app_id")


_SUMS = ("duration_ms", "run_ms", "cpu_ns", "gc_ms", "mem_spill_bytes", "sh_read_bytes", "sh_write_bytes", "in_bytes", "out_bytes")
_DIGEST_SQL = nq("SELECT app_id, e.events, t.* EXCLUDE (app_id) FROM (SELECT app_id, count(*) AS events FROM ev GROUP BY 1) e JOIN (SELECT app_id, count(*) AS tasks, "
                 + ", ".join(f"{big(f'sum({c})')} AS {c}" for c in _SUMS) + " FROM tasks GROUP BY 1) t USING (app_id)")


def _scan_ndjson(s, d):
    return _digest(readers.scan_ndjson(s, logs.write_ndjson(s, d)))


register("scan_ndjson", _scan_ndjson, _DIGEST_SQL)
register("scan_json_array", lambda s, d: _digest(readers.scan_json_array(s, logs.write_arrays(s, d))), _DIGEST_SQL)
register("scan_gzip", lambda s, d: _digest(readers.scan_gzip(s, logs.write_ndjson(s, d), 8)), _DIGEST_SQL)
register("scan_mixed", lambda s, d: _digest(readers.scan_events(s, logs.write_mixed(s, d))), _DIGEST_SQL)
_FMT = "regexp_extract(file, 'app_id=([^/]+)', 1) AS app_id"
_FMT_SQL = nq("SELECT app_id, CASE WHEN app_id < 'app-4' THEN 'array' ELSE 'ndjson' END AS format FROM applications")
register("detect_format", lambda s, d: readers.detect_format(s, logs.write_mixed(s, d)).selectExpr(_FMT, "format").distinct(), _FMT_SQL)
register("detect_format_scan", lambda s, d: readers.detect_format(s, logs.write_mixed(s, d), peek=False).selectExpr(_FMT, "format").distinct(), _FMT_SQL)


def _summarized(s, d):
    t = readers.summarized_tasks(readers.scan_summarized(s, logs.write_summaries(s, d)))
    return t.groupBy("app_id", "stage_id").agg(F.expr("count(1) AS tasks"), F.expr("max(duration_ms) AS duration_ms"), F.expr("sum(run_ms) AS run_ms"), F.expr("sum(cpu_ns) AS cpu_ns"),
                                               F.expr("sum(gc_ms) AS gc_ms"), F.expr("sum(mem_spill_bytes) AS mem_spill_bytes"), F.expr("max(task_id) AS last_task"))


register("scan_summarized", _summarized, nq(
    f"""SELECT app_id, stage_id, count(*) AS tasks, {big('sum(duration_ms) // count(*)')} AS duration_ms, {r6('sum(run_ms)')} AS run_ms, {r6('sum(run_ms) * 0.5 * 1e6')} AS cpu_ns,
    {r6('sum(gc_ms)')} AS gc_ms, {r6('sum(mem_spill_bytes)')} AS mem_spill_bytes, count(*) AS last_task FROM tasks GROUP BY 1, 2"""))


def _sink_events(s, d):
    path = new_path(s, "events-json")
    sinks.write_events_json(N.typed(tables.attach_app_ids(readers.scan_ndjson(s, logs.write_ndjson(s, d)))), path)
    return s.read.schema("app_id STRING, Event STRING, is_valid BOOLEAN").json(path).groupBy("app_id", "Event", "is_valid").count()


register("sink_events_json", _sink_events, nq('SELECT app_id, event AS "Event", ok AS is_valid, count(*) AS count FROM ev GROUP BY 1, 2, 3'))


def _sink_report(s, d):
    path = new_path(s, "report-json")
    sinks.write_report_json(R.report_document(summary(s, d)), path)
    return s.read.schema("value STRING, app_id STRING").text(path).selectExpr("app_id", "value AS document")


register("sink_report_json", _sink_report, DOC_SQL)


def _sink_text(s, d):
    path = new_path(s, "report-text")
    sinks.write_report_text(_lines(s, d), path)
    return s.read.text(path).groupBy("app_id").agg(F.expr("count(1) AS lines"), F.expr("count_if(value LIKE '#%') AS headings"))


register("sink_report_text", _sink_text)


# --- the whole load ---
def _loaded(s, d):
    """Tasks of logs of both forms, through the main entry of the library."""
    t = Corpus.load(s, logs.write_mixed(s, d)).tasks
    return t.groupBy("app_id").agg(F.expr("count(1) AS tasks"), *[F.expr(f"sum({c}) AS {c}") for c in _SUMS])


def _rejects(s, d):
    return Corpus.load(s, logs.write_ndjson(s, d)).rejected.groupBy("app_id", "reason").agg(F.expr("count(1) AS records"))


def _load_counts(s, d):
    """The totals observed while the records were written, beside those of the stored table."""
    corpus = Corpus.load(s, logs.write_ndjson(s, d))
    names = list(N.record_counts())
    taken = s.createDataFrame([tuple(corpus.load_counts[n] for n in names)], ", ".join(f"{n} LONG" for n in names)).selectExpr("'load' AS source", "*")
    return taken.unionByName(corpus.parse_statistics.groupBy().agg(*[F.sum(n).alias(n) for n in names]).selectExpr("'table' AS source", "*"))


register("corpus_load", _loaded, nq("SELECT app_id, count(*) AS tasks, " + ", ".join(f"{big(f'sum({c})')} AS {c}" for c in _SUMS) + " FROM tasks GROUP BY 1"))
register("corpus_rejects", _rejects, nq(
    "SELECT app_id, CASE kind WHEN 'missing' THEN 'no event name' ELSE kind END AS reason, count(*) AS records FROM no WHERE kind IN ('missing', 'malformed') GROUP BY 1, 2"))
register("corpus_load_counts", _load_counts, nq(
    """SELECT source, p + u + ms + mf AS total_records, p AS parsed_events, u AS kept_untyped, ms AS missing_event, mf AS malformed FROM (SELECT unnest(['load', 'table']) AS source),
    (SELECT count(*) FILTER (ok) AS p, count(*) FILTER (NOT ok) AS u FROM ev), (SELECT count(*) FILTER (kind = 'missing') AS ms, count(*) FILTER (kind = 'malformed') AS mf FROM no)"""))

# --- parsing --------------------------------------------------------------------------------------
stored = logs.stored


def parsed(s, d, *fields):
    """Noisy event text parsed with its application; only the ``fields`` if there are any."""
    return readers.parse_lines(stored(logs.noisy_lines(s, d)), fields=fields or None)


TASK_ID = "$['Task Info']['Task ID']"


def clean(s, d, *fields):
    return readers.parse_lines(stored(logs.event_lines(s, d)), fields=fields or None)


register("event_typed", lambda s, d: N.typed(parsed(s, d)).groupBy("app_id", "Event", "is_valid").count(), nq(
    'SELECT app_id, event AS "Event", ok AS is_valid, count(*) AS count FROM ev GROUP BY 1, 2, 3'))
register("event_fallback", lambda s, d: N.untyped(parsed(s, d)).groupBy("app_id", "Event").agg(
    F.expr("count(1) AS kept"), F.expr(f"sum({N.open_field(TASK_ID, 'bigint')}) AS task_ids")), nq(
    f'SELECT app_id, \'SparkListenerTaskEnd\' AS "Event", count(*) AS kept, {big("sum(task_id)")} AS task_ids FROM tasks WHERE task_id % 2 = 0 GROUP BY 1'))
register("missing_event_field", lambda s, d: N.missing_event(parsed(s, d)).selectExpr("app_id", "Timestamp", f"{N.open_field('$.note')} AS note"), nq(
    "SELECT app_id, o_orderkey AS \"Timestamp\", 'no discriminator' AS note FROM no WHERE kind = 'missing'"))
register("normalize_time", lambda s, d: N.normalize_time(N.event_filter(parsed(s, d), "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved")).selectExpr(
    "app_id", "Event", "`Executor ID` AS executor_id", "Timestamp", "ts_ms"), nq(
    """SELECT app_id, CASE kind WHEN 'ADDED' THEN 'SparkListenerExecutorAdded' ELSE 'SparkListenerExecutorRemoved' END AS "Event", executor_id, ts_ms AS "Timestamp", ts_ms FROM executor_events"""))


def _nested_present(s, d):
    n = N.normalize_task_metrics(N.event_filter(parsed(s, d), "SparkListenerTaskEnd"))
    box = "coalesce(`Task Metrics`, `Task Executor Metrics`)"
    return n.groupBy("app_id").agg(
        F.expr(f"count_if({box}.`Output Metrics` IS NOT NULL) AS with_output_record"), F.expr(f"count({box}.`Output Metrics`.`Bytes Written`) AS with_output_bytes"),
        F.expr("count(`Task Metrics`) AS in_task_metrics"), F.expr("count(`Task Executor Metrics`) AS in_executor_metrics"))


register("normalize_task_metrics", _nested_present, nq(
    """SELECT app_id, count(*) AS with_output_record, count(*) FILTER (out_bytes > 0) AS with_output_bytes, count(*) FILTER (task_id % 2 = 0) AS in_task_metrics,
    count(*) FILTER (task_id % 2 = 1) AS in_executor_metrics FROM tasks GROUP BY 1"""))
register("strict_mode", lambda s, d: N.strict(N.event_filter(readers.parse_lines(
    stored(logs.executor_lines(s, d).unionAll(logs.stage_lines(s, d))), strict=True), *["SparkListener" + n for n in (
        "ExecutorAdded", "ExecutorRemoved", "StageSubmitted", "StageCompleted")])).groupBy("app_id", "Event").agg(F.expr("count_if(is_valid) AS valid")), nq(
    "SELECT app_id, event AS \"Event\", count(*) AS valid FROM ev WHERE event LIKE '%Executor%' OR event LIKE '%Stage%' GROUP BY 1, 2"))
register("event_filter", lambda s, d: N.event_counts(N.event_filter(parsed(s, d, "Event"), "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved", "SparkListenerJobEnd")), nq(
    """SELECT app_id, event AS "Event", count(*) AS count FROM ev WHERE event IN ('SparkListenerExecutorAdded', 'SparkListenerExecutorRemoved', 'SparkListenerJobEnd') GROUP BY 1, 2"""))
_TASK_COLS = [n for n, _ in TASK_3 if n not in ("out_records",)]
register("task_extract", lambda s, d: tables.tasks(readers.parse_lines(stored(logs.task_lines(s, d)))).select(*_TASK_COLS), nq(
    f"SELECT {', '.join(_TASK_COLS)} FROM tasks"))
register("task_duration", lambda s, d: tables.tasks(readers.parse_lines(stored(logs.task_lines(s, d)))).filter("duration_ms > 0").select("app_id", "stage_id", "task_id", "launch_ms", "finish_ms", "duration_ms"), nq(
    "SELECT app_id, stage_id, task_id, launch_ms, finish_ms, duration_ms FROM tasks WHERE duration_ms > 0"))


def _nested(s, d):
    def at(*keys):
        return N.open_field("$" + "".join(f"['{k}']" for k in keys), "bigint")

    rows = N.event_filter(parsed(s, d, "Event"), "SparkListenerTaskEnd")
    return rows.groupBy("app_id").agg(
        F.expr(f"sum(coalesce({at('Task Metrics', 'Output Metrics', 'Bytes Written')}, {at('Task Executor Metrics', 'Output Metrics', 'Bytes Written')}, 0)) AS out_bytes"),
        F.expr(f"sum(coalesce({at('Task Metrics', 'No Such Metrics', 'Bytes')}, 0)) AS absent"))


register("nested_get_default", _nested, nq(f"SELECT app_id, {big('sum(out_bytes)')} AS out_bytes, CAST(0 AS BIGINT) AS absent FROM tasks GROUP BY 1"))
register("parse_stats", lambda s, d: N.parse_stats(parsed(s, d)), nq(
    f"""SELECT app_id, p + u + ms + mf AS total_records, p AS parsed_events, u AS kept_untyped, ms AS missing_event, mf AS malformed, u + ms + mf AS failed_events,
    {r6('p / (p + u + ms + mf)')} AS success_rate
    FROM (SELECT app_id, count(*) FILTER (ok) AS p, count(*) FILTER (NOT ok) AS u FROM ev GROUP BY 1)
    JOIN (SELECT app_id, count(*) FILTER (kind = 'missing') AS ms, count(*) FILTER (kind = 'malformed') AS mf FROM no GROUP BY 1) USING (app_id)"""))
register("event_type_counts", lambda s, d: N.event_counts(parsed(s, d, "Event")), nq('SELECT app_id, event AS "Event", count(*) AS count FROM ev GROUP BY 1, 2'))
_ENV = "SELECT app_id, 'spark.app.name' AS key, app_name AS value FROM applications UNION ALL SELECT app_id, 'spark.executor.memory', (4 + length(\"user\")) || 'g' FROM applications " \
       "UNION ALL SELECT app_id, 'spark.sql.shuffle.partitions', '200' FROM applications"
register("environment_props", lambda s, d: tables.environment_props(tables.environment(readers.parse_lines(stored(logs.app_lines(s, d))))), nq(_ENV))
register("environment_columns", lambda s, d: tables.environment_columns(tables.environment(readers.parse_lines(stored(logs.app_lines(s, d)))), "spark.executor.memory", "spark.sql.shuffle.partitions"), nq(
    "SELECT app_id, (4 + length(\"user\")) || 'g' AS spark_executor_memory, '200' AS spark_sql_shuffle_partitions FROM applications"))


def _unfinished(s, d):
    starts = tables.task_starts(readers.parse_lines(stored(logs.start_lines(s, d))))
    ends = BenchCorpus(s, d).tasks.selectExpr("app_id", "stage_id", "stage_attempt", "task_id * 10 AS task_id")
    return tables.unfinished_tasks(starts, ends).select("app_id", "stage_id", "stage_attempt", "task_id", "launch_ms", "executor_id")


register("task_start_end", _unfinished, nq(
    """SELECT app_id, stage_id, stage_attempt, task_key AS task_id, launch_ms, executor_id FROM task_starts s WHERE NOT EXISTS
    (SELECT 1 FROM tasks t WHERE t.app_id = s.app_id AND t.stage_id = s.stage_id AND t.stage_attempt = s.stage_attempt AND t.task_id * 10 = s.task_key)"""))
register("global_counts", lambda s, d: M.global_counts(tables.raw_events(clean(s, d, "Event"))), nq(
    """SELECT app_id, count(*) FILTER (event = 'SparkListenerJobEnd') AS total_jobs, count(*) FILTER (event = 'SparkListenerStageCompleted') AS total_stages,
    count(*) FILTER (event = 'SparkListenerTaskEnd') AS total_tasks, count(*) FILTER (event = 'SparkListenerExecutorAdded') AS executors_added,
    count(*) FILTER (event = 'SparkListenerExecutorRemoved') AS executors_removed, count(*) AS total_events FROM ev GROUP BY 1"""))


def _canonical(build, *names, lines=logs.event_lines):
    """A canonical table parsed from text."""
    def run(s, d):
        return build(readers.parse_lines(stored(lines(s, d)))).selectExpr(*names)

    return run


_CSV = "array_join(transform({0}, x -> CAST(x AS STRING)), ',') AS {0}"
register("canonical_stages", _canonical(tables.stages, "app_id", "stage_id", "attempt", "name", "num_tasks", _CSV.format("parent_ids"), "submission_ms", "completion_ms", "failure_reason",
                                        "is_submitted", "is_completed", "status", lines=logs.stage_lines), nq(
    """SELECT app_id, stage_id, attempt, name, num_tasks, array_to_string(parent_ids, ',') AS parent_ids, submission_ms, completion_ms, failure_reason, is_submitted, is_completed, status FROM stages"""))
register("canonical_jobs", _canonical(tables.jobs, "app_id", "job_id", "submission_ms", "completion_ms", _CSV.format("stage_ids"), "result", "status", lines=logs.job_lines), nq(
    "SELECT app_id, job_id, submission_ms, completion_ms, array_to_string(stage_ids, ',') AS stage_ids, result, status FROM jobs"))
register("canonical_executor_events", _canonical(tables.executor_events, "*", lines=logs.executor_lines), nq("SELECT * FROM executor_events"))
register("canonical_block_managers", _canonical(tables.block_managers, "*", lines=logs.block_lines), nq("SELECT * FROM block_managers"))
register("canonical_applications", _canonical(tables.applications, "*"), nq('SELECT * FROM applications'))
