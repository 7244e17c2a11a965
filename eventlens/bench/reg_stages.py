"""Registry of stage and job queries."""

from eventlens.bench import views as v
from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, div, fbytes, fdur, num, pct, query, r6, transformation
from eventlens.bench.views import BenchCorpus
from eventlens.operators import stages as S
from eventlens.operators.stages import ISSUE_CATEGORIES
from eventlens.plans.stash import stash

WIDE = "('join', 'groupBy', 'shuffle', 'wide')"

STAGE_CTES = f"""
sl AS (SELECT app_id, stage_id, max(attempt) FILTER (is_submitted) AS sa, max(attempt) FILTER (is_completed) AS ca FROM stages GROUP BY 1, 2),
st AS (SELECT l.app_id, l.stage_id, i.attempt AS stage_attempt, i.name AS stage_name, i.num_tasks, i.parent_ids, i.submission_ms,
    c.completion_ms, c.failure_reason, CASE WHEN c.attempt IS NULL THEN 'SUBMITTED' WHEN c.failure_reason IS NOT NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    l.sa IS NULL AS is_orphan
  FROM sl l JOIN stages i ON i.app_id = l.app_id AND i.stage_id = l.stage_id AND i.attempt = coalesce(l.sa, l.ca)
  LEFT JOIN stages c ON c.app_id = l.app_id AND c.stage_id = l.stage_id AND c.attempt = l.ca AND (l.sa IS NULL OR l.ca >= l.sa)),
sm AS (SELECT app_id, stage_id, count(*) AS total_tasks, {big('coalesce(sum(duration_ms) FILTER (duration_ms > 0), 0)')} AS total_duration_ms,
    coalesce(avg(duration_ms) FILTER (duration_ms > 0), 0) AS mean_task_duration_ms,
    coalesce(max(duration_ms) FILTER (duration_ms > 0), 0) AS max_task_duration_ms,
    coalesce(min(duration_ms) FILTER (duration_ms > 0), 0) AS min_task_duration_ms,
    {div('max(duration_ms) FILTER (duration_ms > 0) - min(duration_ms) FILTER (duration_ms > 0)', 'avg(duration_ms) FILTER (duration_ms > 0)')} AS task_skew,
    {big('sum(gc_ms)')} AS total_gc_time_ms, {div('sum(gc_ms)', 'sum(duration_ms) FILTER (duration_ms > 0)')} AS gc_ratio,
    {big('sum(mem_spill_bytes)')} AS total_memory_spilled, {big('sum(sh_read_bytes)')} AS total_shuffle_read,
    {div('sum(sh_read_bytes)', 'sum(sh_read_bytes) + sum(in_bytes)')} AS shuffle_ratio FROM tasks GROUP BY 1, 2),
sd AS (SELECT st.*, coalesce(total_tasks, 0) AS total_tasks, coalesce(total_duration_ms, 0) AS total_duration_ms,
    coalesce(mean_task_duration_ms, 0) AS mean_task_duration_ms, coalesce(max_task_duration_ms, 0) AS max_task_duration_ms,
    coalesce(min_task_duration_ms, 0) AS min_task_duration_ms, coalesce(task_skew, 0) AS task_skew, coalesce(total_gc_time_ms, 0) AS total_gc_time_ms,
    coalesce(gc_ratio, 0) AS gc_ratio, coalesce(total_memory_spilled, 0) AS total_memory_spilled, coalesce(total_shuffle_read, 0) AS total_shuffle_read,
    coalesce(shuffle_ratio, 0) AS shuffle_ratio, {transformation('stage_name', 0)} AS transformation_type, {transformation('stage_name', 1)} AS operation
  FROM st LEFT JOIN sm USING (app_id, stage_id)),
si AS (
  SELECT app_id, stage_id, 0 AS ord, 'HIGH_GC' AS type, CASE WHEN gc_ratio > 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    'High GC overhead: ' || {pct('gc_ratio')} || ' of stage time' AS description, 'gc_ratio' AS metric, gc_ratio AS value FROM sd WHERE gc_ratio > 0.2
  UNION ALL SELECT app_id, stage_id, 1, 'DATA_SKEW', CASE WHEN task_skew > 1 THEN 'HIGH' ELSE 'MEDIUM' END,
    'Data skew detected: task duration variance ' || {pct('task_skew')}, 'task_skew', task_skew FROM sd WHERE task_skew > 0.5
  UNION ALL SELECT app_id, stage_id, 2, 'MEMORY_SPILL', CASE WHEN total_memory_spilled > 1000000000 THEN 'HIGH' ELSE 'MEDIUM' END,
    'Memory spill: ' || {fbytes('total_memory_spilled')}, 'total_memory_spilled', total_memory_spilled FROM sd WHERE total_memory_spilled > 100000000
  UNION ALL SELECT app_id, stage_id, 3, 'EXCESSIVE_SHUFFLE', 'HIGH', 'Excessive shuffle: ' || {pct('shuffle_ratio')} || ' of data', 'shuffle_ratio',
    shuffle_ratio FROM sd WHERE shuffle_ratio > 0.5
  UNION ALL SELECT app_id, stage_id, 4, 'STRAGGLER_TASKS', 'MEDIUM', 'Straggler tasks detected: max task is ' ||
    {num('max_task_duration_ms / mean_task_duration_ms', 1)} || 'x slower than mean', 'max_vs_mean_ratio', max_task_duration_ms / mean_task_duration_ms
    FROM sd WHERE mean_task_duration_ms > 0 AND max_task_duration_ms > 2 * mean_task_duration_ms
  UNION ALL SELECT app_id, stage_id, 5, 'STAGE_FAILURE', 'CRITICAL', 'Stage failed: ' || failure_reason, 'failure', NULL
    FROM sd WHERE status = 'FAILED' AND total_tasks > 0),
sx AS (SELECT app_id, stage_id, count(*) AS issue_count, min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END) AS sev_rank,
    string_agg(type || '[' || severity || ']', ',' ORDER BY ord) AS issue_text FROM si GROUP BY 1, 2)"""


def sq(sql: str, *extra: str) -> str:
    return query(sql, STAGE_CTES, *extra)


ISSUE_TEXT = "array_join(transform(issues, i -> concat(i.type, '[', i.severity, ']')), ',') AS issue_text"
IDS = "array_join(transform({0}, x -> CAST(x AS STRING)), ',') AS {0}"


def details(s, d):
    c = BenchCorpus(s, d)
    return S.stage_details(c.stages, c.tasks)


register("stage_table", lambda s, d: S.stage_table(BenchCorpus(s, d).stages).selectExpr(
    "app_id", "stage_id", "stage_attempt", "stage_name", "num_tasks", IDS.format("parent_ids"), "submission_ms", "completion_ms",
    "failure_reason", "status", "is_orphan"), sq(
    "SELECT app_id, stage_id, stage_attempt, stage_name, num_tasks, array_to_string(parent_ids, ',') AS parent_ids, submission_ms, completion_ms, "
    "failure_reason, status, is_orphan FROM st"))
register("job_table", lambda s, d: S.job_table(BenchCorpus(s, d).jobs).selectExpr(
    "app_id", "job_id", "submission_ms", "completion_ms", IDS.format("stage_ids"), "result", "status"), sq(
    "SELECT app_id, job_id, submission_ms, completion_ms, array_to_string(stage_ids, ',') AS stage_ids, result, status FROM jobs"))
register("stage_tasks", lambda s, d: details(s, d).selectExpr("app_id", "stage_id", "status", "num_tasks", "total_tasks"), sq(
    "SELECT app_id, stage_id, status, num_tasks, total_tasks FROM sd"))
_SM = ("task_skew", "gc_ratio", "shuffle_ratio", "mean_task_duration_ms")
register("stage_metrics", lambda s, d: S.stage_metrics(BenchCorpus(s, d).tasks), sq(
    "SELECT app_id, stage_id, total_tasks, total_duration_ms, max_task_duration_ms, min_task_duration_ms, total_gc_time_ms, total_memory_spilled, "
    "total_shuffle_read, " + ", ".join(f"{r6(n)} AS {n}" for n in _SM) + " FROM sm"))
register("stage_issues", lambda s, d: S.stage_issues(details(s, d)), sq(
    f"SELECT app_id, stage_id, row_number() OVER (PARTITION BY app_id, stage_id ORDER BY ord) - 1 AS pos, type, severity, description, metric, {r6('value')} AS value FROM si"))
register("stage_transformation", lambda s, d: S.stage_transformation(BenchCorpus(s, d).stages).selectExpr("* EXCEPT (rdd_names)", "array_join(rdd_names, ',') AS rdd_names"), sq(
    f"""SELECT app_id, stage_id, stage_name, transformation_type, operation, 'MapPartitionsRDD,' || split_part(stage_name, ' ', 1) AS rdd_names,
    contains(lower(stage_name), 'shuffle') OR contains(lower(stage_name), 'exchange') AS is_shuffle_stage,
    transformation_type IN {WIDE} AS is_wide_transformation FROM sd"""))
register("stage_task_summary", lambda s, d: S.stage_task_summary(BenchCorpus(s, d).tasks).selectExpr(
    "* EXCEPT (locality_distribution)", "array_join(transform(map_entries(locality_distribution), e -> concat(e.key, '=', e.value)), ',') AS localities"), sq(
    """SELECT app_id, stage_id, total_tasks, unique_executors, speculative_tasks, localities FROM
    (SELECT app_id, stage_id, count(*) AS total_tasks, count(DISTINCT executor_id) AS unique_executors, count(*) FILTER (speculative) AS speculative_tasks
     FROM tasks GROUP BY 1, 2) JOIN
    (SELECT app_id, stage_id, string_agg(locality || '=' || n, ',' ORDER BY locality) AS localities FROM
     (SELECT app_id, stage_id, locality, count(*) AS n FROM tasks GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (app_id, stage_id)"""))
register("job_stages", lambda s, d: S.job_stages(BenchCorpus(s, d).jobs, BenchCorpus(s, d).stages), sq(
    """SELECT j.app_id, j.job_id, j.stage_id, st.stage_name, st.status FROM (SELECT app_id, job_id, unnest(stage_ids) AS stage_id FROM jobs) j
    JOIN st ON st.app_id = j.app_id AND st.stage_id = j.stage_id"""))
register("job_metrics", lambda s, d: S.job_metrics(BenchCorpus(s, d).jobs, details(s, d)).selectExpr(
    "* EXCEPT (stage_ids, failed_stages, problematic_stages)", IDS.format("stage_ids"), IDS.format("failed_stages"), IDS.format("problematic_stages")), sq(
    f"""SELECT j.app_id, j.job_id, j.status, CAST(len(j.stage_ids) AS BIGINT) AS total_stages, j.submission_ms, j.completion_ms,
    array_to_string(j.stage_ids, ',') AS stage_ids, {big('sum(sd.total_duration_ms)')} AS total_duration_ms, {big('sum(sd.total_tasks)')} AS total_tasks,
    coalesce(string_agg(CAST(sd.stage_id AS VARCHAR), ',' ORDER BY sd.stage_id) FILTER (sd.status = 'FAILED'), '') AS failed_stages,
    coalesce(string_agg(CAST(sd.stage_id AS VARCHAR), ',' ORDER BY sd.stage_id) FILTER (sx.issue_count > 0), '') AS problematic_stages
    FROM jobs j JOIN sd ON sd.app_id = j.app_id AND list_contains(j.stage_ids, sd.stage_id)
    LEFT JOIN sx ON sx.app_id = sd.app_id AND sx.stage_id = sd.stage_id GROUP BY j.app_id, j.job_id, j.status, j.stage_ids, j.submission_ms, j.completion_ms"""))
register("problem_transformations", lambda s, d: S.problem_transformations(details(s, d)).selectExpr("* EXCEPT (issues)", ISSUE_TEXT), sq(
    f"""SELECT app_id, stage_id, stage_name, transformation_type, operation, transformation_type IN {WIDE} AS is_wide_transformation, issue_text,
    CAST(sev_rank AS BIGINT) AS sev_rank, ['CRITICAL', 'HIGH', 'MEDIUM'][sev_rank + 1] AS severity FROM sd JOIN sx USING (app_id, stage_id)"""))
_CAT = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in ISSUE_CATEGORIES.items())
register("bottleneck_mapping", lambda s, d: S.bottleneck_mapping(details(s, d)), sq(
    f"SELECT app_id, CASE type {_CAT} END AS category, stage_id FROM si WHERE type <> 'STRAGGLER_TASKS'"))
HOT_CTE = f"""sh AS (SELECT app_id, stage_id, stage_name, total_duration_ms AS duration_ms, {fdur('total_duration_ms')} AS duration_formatted,
    total_tasks AS task_count, coalesce(issue_count, 0) AS issue_count, transformation_type,
    row_number() OVER (PARTITION BY app_id ORDER BY total_duration_ms DESC, stage_id) AS rank
    FROM sd LEFT JOIN sx USING (app_id, stage_id) WHERE total_duration_ms > 0 QUALIFY rank <= 10)"""
register("stage_hotspots", lambda s, d: S.stage_hotspots(details(s, d)), sq("SELECT * FROM sh", HOT_CTE))
SUM_CTE = f"""ss AS (SELECT app_id, count(*) AS total_stages, count(*) FILTER (status = 'FAILED') AS failed_stages,
    count(issue_count) AS stages_with_issues, count(*) - count(issue_count) AS healthy_stages, {big('sum(total_duration_ms)')} AS total_duration_ms
    FROM sd LEFT JOIN sx USING (app_id, stage_id) GROUP BY 1)"""
register("stage_summary", lambda s, d: S.stage_summary(details(s, d)), sq(
    f"SELECT *, {fdur('total_duration_ms')} AS total_duration_formatted FROM ss", SUM_CTE))
register("job_summary", lambda s, d: S.job_summary(BenchCorpus(s, d).jobs), sq(
    "SELECT app_id, count(*) AS total_jobs, count(*) FILTER (status = 'FAILED') AS failed_jobs, count(*) FILTER (status <> 'FAILED') AS successful_jobs FROM jobs GROUP BY 1"))
register("stage_lineage", lambda s, d: S.stage_lineage(BenchCorpus(s, d).stages), "WITH RECURSIVE " + sq(
    """SELECT e.app_id, e.stage_id, e.parent_id, p.status AS parent_status, CAST(dp.depth AS BIGINT) AS depth, false AS cyclic FROM ed e
    JOIN (SELECT app_id, stage_id, max(depth) AS depth FROM rc GROUP BY 1, 2) dp USING (app_id, stage_id)
    LEFT JOIN st p ON p.app_id = e.app_id AND p.stage_id = e.parent_id""",
    "ed AS (SELECT app_id, stage_id, unnest(parent_ids) AS parent_id FROM st)",
    """rc AS (SELECT DISTINCT app_id, stage_id, 1 AS depth FROM ed
    UNION SELECT ed.app_id, ed.stage_id, rc.depth + 1 FROM ed JOIN rc ON rc.app_id = ed.app_id AND rc.stage_id = ed.parent_id)""").removeprefix("WITH "))
# a chain of 300 stages, its numbers taken from the orders, beside the wide graphs of the applications
_CHAIN = "SELECT DISTINCT 'app-chain' AS app_id, o_orderkey % 300 AS stage_id FROM orders"


def _chained(s, d):
    wide = v.stages(s, d)
    chain = v._read(s, d, "orders").selectExpr("'app-chain' AS app_id", "o_orderkey % 300 AS stage_id").distinct().selectExpr(
        "*", "0L AS attempt", "'link' AS name", "1L AS num_tasks", "IF(stage_id = 0, array(), array(stage_id - 1)) AS parent_ids", "0L AS submission_ms", "true AS is_submitted",
        "true AS is_completed", "1L AS completion_ms", "CAST(NULL AS STRING) AS failure_reason", "CAST(array() AS ARRAY<STRING>) AS rdd_names", "'SUCCESS' AS status")
    return wide.unionByName(chain)


def _ancestors(s, d):
    rows = stash(_chained(s, d))
    return S.ancestors_of(rows, rows.where("stage_id % 50 = 49 OR stage_id > 390").select("app_id", "stage_id"))


register("ancestors_of", _ancestors, "WITH RECURSIVE " + sq(
    """SELECT app_id, stage_id, ancestor_id, min(hops) AS hops FROM up GROUP BY 1, 2, 3""",
    f"""ed AS (SELECT DISTINCT app_id, stage_id, unnest(parent_ids) AS parent_id FROM st
    UNION SELECT app_id, stage_id, stage_id - 1 FROM ({_CHAIN}) WHERE stage_id > 0)""",
    """up AS (SELECT app_id, stage_id, parent_id AS ancestor_id, CAST(1 AS BIGINT) AS hops FROM ed WHERE stage_id % 50 = 49 OR stage_id > 390
    UNION SELECT up.app_id, up.stage_id, ed.parent_id, up.hops + 1 FROM up JOIN ed ON ed.app_id = up.app_id AND ed.stage_id = up.ancestor_id)""").removeprefix("WITH "))
register("stage_gc_series", lambda s, d: S.stage_gc_series(details(s, d)), sq(
    f"""SELECT app_id, stage_id, 'Stage ' || stage_id AS label, {r6('gc_ratio * 100')} AS gc_percent, CASE WHEN gc_ratio * 100 > 25 THEN 'critical'
    WHEN gc_ratio * 100 > 15 THEN 'high' WHEN gc_ratio * 100 > 10 THEN 'medium' ELSE 'low' END AS band FROM sd"""))
register("stage_shuffle_series", lambda s, d: S.stage_shuffle_series(BenchCorpus(s, d).tasks), sq(
    f"SELECT app_id, stage_id, 'Stage ' || stage_id AS label, {big('sum(fetch_wait_ms) + sum(sh_write_time)')} AS shuffle_time_ms FROM tasks GROUP BY 1, 2"))
