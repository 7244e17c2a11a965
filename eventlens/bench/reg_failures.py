"""Registry of failure queries."""

from eventlens.bench.reg_stages import STAGE_CTES
from eventlens.bench.registry import register
from eventlens.bench.sqltext import big, classify, div, executor_failed, fbytes, pct, query, r6
from eventlens.bench.views import BenchCorpus
from eventlens.functions.text import FAILURE_PATTERNS
from eventlens.operators import failures as G
from eventlens.operators import metrics as M
from eventlens.operators.failures import HYPOTHESES
from eventlens.operators.stages import stage_metrics

OOM = "OutOfMemoryError|Java heap space|GC overhead limit exceeded"
BAD = "end_reason IS NOT NULL AND end_reason <> 'Success'"


def hyp(kind: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in HYPOTHESES.items())
    return f"(CASE {kind} {arms} ELSE 'Failure of type ' || {kind} || '. Review logs for details.' END)"


OOM_CAUSE = f"""concat_ws('. ', CASE WHEN gc_overhead_ratio > 0.3 THEN 'Excessive GC overhead indicating severe memory pressure' END,
  CASE WHEN memory_bytes_spilled > 1000000000 THEN 'Large memory spill (' || {fbytes('memory_bytes_spilled')} || ') indicating insufficient memory' END,
  CASE WHEN gc_overhead_ratio <= 0.3 AND memory_bytes_spilled <= 1000000000 THEN 'Insufficient executor memory for workload' END)
  || '. Recommendation: Increase spark.executor.memory significantly.'"""
EXEC_CAUSE = f"""CASE WHEN failure_type = 'OOM' OR gc_pressure_level IN ('CRITICAL', 'HIGH') THEN 'Executor likely failed due to memory pressure (GC pressure: ' ||
  gc_pressure_level || '). Increase spark.executor.memory and spark.executor.memoryOverhead.' ELSE {hyp('failure_type')} END"""
FETCH_CAUSE = f"""CASE WHEN shuffle_ratio > 0.5 THEN 'Heavy shuffle operations (' || {pct('shuffle_ratio')} || ' of time, ' || {fbytes('total_shuffle_bytes')} ||
  ' data) likely causing network congestion. Consider reducing shuffle volume or enabling external shuffle service.'
  ELSE 'Network instability or executor failure during shuffle. Check network configuration and executor stability.' END"""
FAILURE_CTES = f"""
ef AS (SELECT app_id, executor_id, {classify('reason')} AS failure_type, reason AS removed_reason, ts_ms AS timestamp_ms FROM executor_events
    WHERE kind = 'REMOVED' AND {executor_failed('reason')}),
om AS (SELECT app_id, 'Task OOM' AS type, task_id, stage_id, executor_id, finish_ms AS timestamp_ms, CAST(NULL AS VARCHAR) AS removed_reason
    FROM tasks WHERE regexp_matches(end_reason_json, '{OOM}', 'i')
    UNION ALL SELECT app_id, 'Executor OOM', NULL, NULL, executor_id, ts_ms, reason FROM executor_events WHERE kind = 'REMOVED' AND regexp_matches(reason, '{OOM}', 'i')),
ff AS (SELECT app_id, task_id, stage_id, executor_id, finish_ms AS timestamp_ms, end_reason_json AS failure_reason FROM tasks WHERE contains(end_reason, 'FetchFailed')),
tf AS (SELECT *, {classify('end_reason_json')} AS failure_type FROM tasks WHERE {BAD}),
sf AS (SELECT app_id, stage_id, attempt AS stage_attempt, {classify('failure_reason')} AS failure_type, failure_reason, completion_ms AS timestamp_ms
    FROM stages WHERE failure_reason IS NOT NULL),
fc AS (SELECT a.app_id, (SELECT count(*) FROM sf WHERE sf.app_id = a.app_id) AS total_stage_failures, (SELECT count(*) FROM tf WHERE tf.app_id = a.app_id) AS total_task_failures,
    (SELECT count(*) FROM ef WHERE ef.app_id = a.app_id) AS total_executor_failures, (SELECT count(*) FROM om WHERE om.app_id = a.app_id) AS total_oom_events,
    (SELECT count(*) FROM ff WHERE ff.app_id = a.app_id) AS total_fetch_failures,
    (SELECT count(*) FROM tasks t WHERE t.app_id = a.app_id) + (SELECT count(*) FROM stages s WHERE s.app_id = a.app_id)
      + (SELECT count(*) FROM executor_events e WHERE e.app_id = a.app_id AND kind = 'ADDED') AS attempts FROM applications a)"""


def fq(sql: str, *extra: str) -> str:
    return query(sql, STAGE_CTES, FAILURE_CTES, *extra)


def metrics(s, d, *groups):
    return M.app_metrics(BenchCorpus(s, d), *groups)


register("classify_failure", lambda s, d: G.classified(BenchCorpus(s, d).tasks), fq(
    f"SELECT app_id, end_reason_json, {classify('end_reason_json')} AS failure_type, count(*) AS occurrences FROM tasks GROUP BY 1, 2, 3"))
register("stage_failures", lambda s, d: G.stage_failures(BenchCorpus(s, d).stages, stage_metrics(BenchCorpus(s, d).tasks)), fq(
    f"""SELECT sf.*, total_tasks, total_duration_ms, {r6('gc_ratio')} AS gc_ratio, total_memory_spilled, {r6('shuffle_ratio')} AS shuffle_ratio,
    {hyp('failure_type')} AS root_cause_hypothesis FROM sf LEFT JOIN sm USING (app_id, stage_id)"""))
register("task_failures", lambda s, d: G.task_failures(BenchCorpus(s, d).tasks), fq(
    """SELECT app_id, task_id, stage_id, executor_id, failure_type, end_reason AS failure_reason, end_reason_json AS task_end_reason, finish_ms AS timestamp_ms, duration_ms,
    run_ms AS executor_run_time, gc_ms AS jvm_gc_time, mem_spill_bytes AS memory_bytes_spilled, sh_read_bytes AS shuffle_read_bytes FROM tf"""))
register("executor_failures", lambda s, d: G.executor_failures(BenchCorpus(s, d).executor_events, metrics(s, d, "gc")).drop("suspected_cause"), fq("SELECT * FROM ef"))
register("oom_events", lambda s, d: G.oom_events(BenchCorpus(s, d).tasks, BenchCorpus(s, d).executor_events, metrics(s, d, "gc", "spill")), fq(
    f"SELECT om.*, gc_pressure_level AS gc_pressure_at_time, {OOM_CAUSE} AS likely_cause FROM om JOIN m USING (app_id)"))
register("fetch_failures", lambda s, d: G.fetch_failures(BenchCorpus(s, d).tasks, metrics(s, d, "shuffle")), fq(
    f"SELECT ff.*, {r6('shuffle_ratio')} AS shuffle_ratio, {big('total_shuffle_bytes')} AS total_shuffle_bytes, {FETCH_CAUSE} AS likely_cause FROM ff JOIN m USING (app_id)"))
register("failure_hypothesis", lambda s, d: G.failure_hypotheses(BenchCorpus(s, d).tasks), fq(
    f"SELECT app_id, failure_type, count(*) AS failures, {hyp('failure_type')} AS hypothesis FROM tf GROUP BY 1, 2"))
register("executor_failure_cause", lambda s, d: G.executor_failures(BenchCorpus(s, d).executor_events, metrics(s, d, "gc")), fq(
    f"SELECT ef.*, {EXEC_CAUSE} AS suspected_cause FROM ef JOIN m USING (app_id)"))
register("oom_cause", lambda s, d: metrics(s, d, "gc", "spill").selectExpr("app_id", "gc_pressure_level", f"{G.oom_cause()} AS likely_cause"), fq(
    f"SELECT app_id, gc_pressure_level, {OOM_CAUSE} AS likely_cause FROM m"))
register("failure_summary", lambda s, d: G.failure_summary(G.failure_counts(BenchCorpus(s, d).tasks, BenchCorpus(s, d).stages, BenchCorpus(s, d).executor_events)), fq(
    f"""SELECT app_id, total_stage_failures, total_task_failures, total_executor_failures, total_oom_events, total_fetch_failures,
    total_oom_events > 0 OR total_stage_failures > 0 AS has_critical_failures,
    {r6('total_stage_failures + total_task_failures + total_executor_failures')} AS failure_count,
    {r6(div('total_stage_failures + total_task_failures + total_executor_failures', 'attempts'))} AS failure_rate FROM fc"""))
_PIVOT = ", ".join(f"count(*) FILTER (failure_type = '{k}') AS {k.lower()}" for k in [p for p, _ in FAILURE_PATTERNS] + ["UNKNOWN"])
register("failures_by_type", lambda s, d: G.failures_by_type(BenchCorpus(s, d).tasks), fq(f"SELECT app_id, stage_id, {_PIVOT} FROM tf GROUP BY 1, 2"))
