"""Registry of executor queries."""

from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, div, fdur, query, r6
from eventlens.bench.views import BenchCorpus
from eventlens.operators import executors as X
from eventlens.operators.executors import ANOMALY_TEXTS

EXECUTOR_CTES = f"""
xe AS (SELECT app_id, executor_id, max(ts_ms) FILTER (kind = 'ADDED') AS added_ms, max(ts_ms) FILTER (kind = 'REMOVED') AS removed_ms,
    max(coalesce(reason, '')) FILTER (kind = 'REMOVED') AS removal_reason, max(cores) FILTER (kind = 'ADDED') AS cores,
    string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, count(*) FILTER (kind = 'ADDED') AS times_added FROM executor_events GROUP BY 1, 2),
xt AS (SELECT app_id, executor_id, count(*) AS n, {big('sum(duration_ms)')} AS busy FROM tasks WHERE executor_id IS NOT NULL GROUP BY 1, 2),
xs AS (SELECT coalesce(xe.app_id, xt.app_id) AS app_id, coalesce(xe.executor_id, xt.executor_id) AS executor_id, added_ms, removed_ms, removal_reason,
    coalesce(hosts, '') AS hosts, cores, coalesce(times_added, 0) AS times_added, coalesce(n, 0) AS tasks_executed, coalesce(busy, 0) AS total_duration_ms,
    removed_ms - added_ms AS lifetime_ms
    FROM xe FULL OUTER JOIN xt ON xe.app_id = xt.app_id AND xe.executor_id = xt.executor_id)"""


def xq(sql: str, *extra: str) -> str:
    return query(sql, EXECUTOR_CTES, *extra)


def stats(s, d):
    c = BenchCorpus(s, d)
    return X.executor_stats(c.executor_events, c.tasks)


register("executor_timeline", lambda s, d: X.executor_timeline(BenchCorpus(s, d).executor_events), xq(
    """SELECT e.app_id, e.ts_ms, e.kind AS event, e.executor_id, e.host, e.cores, e.reason,
    CASE WHEN e.kind = 'REMOVED' THEN coalesce(e.ts_ms - xe.added_ms, 0) END AS lifetime_ms FROM executor_events e JOIN xe USING (app_id, executor_id)"""))
register("executor_stats", lambda s, d: stats(s, d).selectExpr("* EXCEPT (hosts)", "array_join(hosts, ',') AS hosts"), xq("SELECT * FROM xs"))
register("executor_lifetime", lambda s, d: X.executor_lifetime(stats(s, d)), xq(
    "SELECT app_id, executor_id, added_ms, removed_ms, lifetime_ms FROM xs WHERE lifetime_ms IS NOT NULL"))
register("heartbeat_timeouts", lambda s, d: X.heartbeat_timeouts(BenchCorpus(s, d).executor_events), xq(
    """SELECT app_id, 'FREQUENT_HEARTBEAT_TIMEOUTS' AS type, CASE WHEN count(*) > 2 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS count,
    count(*) || ' executor(s) lost due to heartbeat timeout' AS description
    FROM executor_events WHERE kind = 'REMOVED' AND lower(reason) LIKE '%heartbeat%' GROUP BY 1"""))
register("short_lived_executors", lambda s, d: X.short_lived_executors(stats(s, d)), xq(
    """SELECT app_id, executor_id, coalesce(lifetime_ms, 0) AS lifetime_ms, removal_reason AS reason FROM xs
    WHERE removed_ms IS NOT NULL AND coalesce(lifetime_ms, 0) < 60000"""))
register("idle_executors", lambda s, d: X.idle_executors(stats(s, d)), xq(
    "SELECT app_id, executor_id, removed_ms FROM xs WHERE removed_ms IS NOT NULL AND tasks_executed = 0"))
ANOMALY_CTE = """xa AS (
    SELECT app_id, 'FREQUENT_HEARTBEAT_TIMEOUTS' AS type, CASE WHEN count(*) > 2 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS count,
      count(*) || ' executor(s) lost due to heartbeat timeout' AS description FROM xs WHERE removed_ms IS NOT NULL AND lower(removal_reason) LIKE '%heartbeat%' GROUP BY 1
    UNION ALL SELECT app_id, 'SHORT_LIVED_EXECUTORS', 'HIGH', count(*), count(*) || ' executor(s) lived less than 1 minute'
      FROM xs WHERE removed_ms IS NOT NULL AND coalesce(lifetime_ms, 0) < 60000 GROUP BY 1
    UNION ALL SELECT app_id, 'IDLE_EXECUTORS', 'MEDIUM', count(*), count(*) || ' executor(s) executed no tasks'
      FROM xs WHERE removed_ms IS NOT NULL AND tasks_executed = 0 GROUP BY 1)"""
_CAUSE = " ".join(f"WHEN '{t}' THEN '{c}'" for t, (c, _) in ANOMALY_TEXTS.items())
_ADVICE = " ".join(f"WHEN '{t}' THEN '{r}'" for t, (_, r) in ANOMALY_TEXTS.items())
register("executor_anomalies", lambda s, d: X.executor_anomalies(stats(s, d)), xq(
    f"SELECT *, CASE type {_CAUSE} END AS probable_cause, CASE type {_ADVICE} END AS recommendation FROM xa", ANOMALY_CTE))
register("executor_summary", lambda s, d: X.executor_summary(stats(s, d)), xq(
    f"""SELECT t.app_id, total_executors, executors_added, executors_removed, {big('floor(life)')} AS avg_lifetime_ms, {fdur('life')} AS avg_lifetime_formatted,
    total_tasks_executed, CASE WHEN executors_removed = 0 THEN 'STABLE' ELSE 'UNSTABLE' END AS executor_stability, removal_reason, reason_count
    FROM (SELECT app_id, count(*) AS total_executors, {big('sum(times_added)')} AS executors_added, count(removed_ms) AS executors_removed,
      coalesce(avg(lifetime_ms) FILTER (lifetime_ms <> 0), 0) AS life, {big('sum(tasks_executed)')} AS total_tasks_executed FROM xs GROUP BY 1) t
    LEFT JOIN (SELECT app_id, removal_reason, count(*) AS reason_count FROM xs WHERE removal_reason <> '' GROUP BY 1, 2) r USING (app_id)"""))
register("block_manager_capacity", lambda s, d: X.block_manager_capacity(BenchCorpus(s, d).block_managers), xq(
    "SELECT app_id, executor_id, max_onheap, max_offheap, added_ms, removed_ms FROM block_managers"))
_PCT = div("heap_used", "max_onheap") + " * 100"
register("executor_memory_timeline", lambda s, d: X.executor_memory_timeline(BenchCorpus(s, d).tasks, BenchCorpus(s, d).block_managers), xq(
    f"""SELECT app_id, executor_id, w * 60000 AS window_start_ms, heap_used, max_onheap, {r6(_PCT)} AS used_percent,
    CASE WHEN {_PCT} > 90 THEN 'critical' WHEN {_PCT} > 80 THEN 'high' ELSE 'normal' END AS band, {div('gc', 'run')} > 0.1 AS gc_mark
    FROM (SELECT app_id, executor_id, finish_ms // 60000 AS w, max(heap_bytes) AS heap_used, sum(gc_ms) AS gc, sum(run_ms) AS run FROM tasks GROUP BY 1, 2, 3)
    LEFT JOIN (SELECT app_id, executor_id, max_onheap FROM block_managers) USING (app_id, executor_id)"""))
