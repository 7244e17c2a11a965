"""Registry of root-cause, chain and rule queries."""

from eventlens.bench.reg_detectors import FINDING_CTES
from eventlens.bench.reg_failures import FAILURE_CTES
from eventlens.bench.reg_metrics import LONG_CTE
from eventlens.bench.reg_stages import STAGE_CTES
from eventlens.bench.registry import register
from eventlens.bench.sqltext import fbytes, fdur, num, pct, query, r6, rank
from eventlens.bench.views import BenchCorpus
from eventlens.functions.text import map_text
from eventlens.operators import causes as H
from eventlens.operators import detectors as D
from eventlens.operators import failures as G
from eventlens.operators import metrics as M
from eventlens.operators import rules as R
from eventlens.operators import stages as S
from eventlens.plans.corpus import Diagnosis

# Fixed texts that the results must carry, stated once more in the other dialect
_SHUF = "(shuffle_read_bytes + shuffle_write_bytes)"
RECS = {
    "bn_gc_pressure": f"""CASE WHEN gc_overhead_ratio > 0.4 THEN 'CRITICAL: GC overhead is ' || {pct('gc_overhead_ratio')} || ', severely impacting performance. Immediately increase executor memory by at least 50% and enable G1GC.'
      WHEN gc_overhead_ratio > 0.2 THEN 'HIGH: GC overhead is ' || {pct('gc_overhead_ratio')} || '. Increase executor memory by 20-30% and tune GC settings. Consider reviewing caching strategy.'
      ELSE 'Moderate GC overhead detected (' || {pct('gc_overhead_ratio')} || '). Monitor and increase memory if it worsens.' END""",
    "bn_shuffle": f"""CASE WHEN shuffle_ratio > 0.7 THEN 'CRITICAL: Shuffle operations consume ' || {pct('shuffle_ratio')} || ' of execution time (' || {fbytes(_SHUF)} || ' shuffled). Enable AQE and optimize join strategy immediately.'
      WHEN shuffle_ratio > 0.5 THEN 'HIGH: Excessive shuffle overhead (' || {pct('shuffle_ratio')} || ' of time, ' || {fbytes(_SHUF)} || ' data). Enable broadcast joins and AQE.'
      ELSE 'Moderate shuffle detected. Consider optimizing if shuffle grows.' END""",
    "bn_data_skew": f"""CASE WHEN task_skew_ratio > 1 OR max_task_duration / min_task_duration > 10 THEN 'CRITICAL: Severe data skew detected. Slowest task is ' || {num('max_task_duration / min_task_duration', 1)} || 'x slower than fastest. Enable skew join optimization and use salting technique.'
      WHEN task_skew_ratio > 0.5 THEN 'HIGH: Significant data skew (variance ' || {num('task_skew_ratio', 2)} || '). Enable AQE skew handling and repartition data.'
      ELSE 'Moderate skew detected. Monitor partition sizes.' END""",
    "bn_cpu_underuse": f"""CASE WHEN cpu_efficiency < 0.4 THEN 'CRITICAL: CPUs are ' || {pct('(1 - cpu_efficiency)')} || ' idle. Likely I/O bound or severe serialization overhead. Investigate disk/network bottlenecks immediately.'
      WHEN cpu_efficiency < 0.6 THEN 'HIGH: CPU utilization is only ' || {pct('cpu_efficiency')} || '. Increase parallelism and check for I/O bottlenecks.'
      ELSE 'Suboptimal CPU usage (' || {pct('cpu_efficiency')} || '). Consider increasing cores per executor.' END""",
    "bn_executor_imbalance": f"""CASE WHEN executor_imbalance_ratio > 0.6 THEN 'CRITICAL: Severe load imbalance. Max executor has ' || max_tasks_per_executor || ' tasks vs min ' || min_tasks_per_executor || '. Repartition data immediately and check for skewed keys.'
      WHEN executor_imbalance_ratio > 0.4 THEN 'HIGH: Significant load imbalance (ratio ' || {num('executor_imbalance_ratio', 2)} || '). Review partitioning strategy and enable dynamic allocation.'
      ELSE 'Moderate imbalance detected. Monitor executor utilization.' END""",
    "bn_memory_spill": f"""CASE WHEN spill_ratio > 0.3 THEN 'CRITICAL: ' || {fbytes('memory_bytes_spilled')} || ' spilled to disk (' || {pct('spill_ratio')} || ' of data). Increase executor memory by at least 50% immediately.'
      WHEN spill_ratio > 0.1 THEN 'HIGH: ' || {fbytes('memory_bytes_spilled')} || ' spilled. Increase executor memory by 20-30%.'
      ELSE 'Memory spill detected (' || {fbytes('memory_bytes_spilled')} || '). Monitor and adjust if needed.' END""",
}
_NAME = {"GC": ("bn_gc_pressure", "bottleneck LIKE 'GC %'"), "SH": ("bn_shuffle", "type = 'SHUFFLE'"), "SK": ("bn_data_skew", "type = 'DATA_SKEW'"),
         "CPU": ("bn_cpu_underuse", "type = 'CPU'"), "EX": ("bn_executor_imbalance", "type = 'EXECUTOR'"), "SP": ("bn_memory_spill", "bottleneck LIKE 'Memory Spill%'")}
DET = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _NAME.values()) + " END"
_REC = "CASE detector " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RECS.items()) + " END"
_CAUSE = "CASE detector " + " ".join(f"WHEN '{k}' THEN '{c.name}'" for k, c in H.CAUSES.items()) + " END"


def _sup(pairs):
    return " || '; ' || ".join(f"'{k}=' || {v}" for k, v in pairs) + " || '; impact=' || impact"


_SUPPORT = f"""CASE detector
  WHEN 'bn_gc_pressure' THEN {_sup([('gc_overhead_percentage', pct('gc_overhead_ratio', 2)), ('memory_spilled_bytes', 'memory_bytes_spilled'), ('memory_spilled_formatted', fbytes('memory_bytes_spilled'))])}
  WHEN 'bn_shuffle' THEN {_sup([('shuffle_time_percentage', pct('shuffle_ratio', 2)), ('shuffle_read_formatted', fbytes('shuffle_read_bytes')), ('shuffle_write_formatted', fbytes('shuffle_write_bytes')), ('total_shuffle_formatted', fbytes(_SHUF))])}
  WHEN 'bn_data_skew' THEN {_sup([('task_skew_ratio', num('task_skew_ratio', 2)), ('mean_task_duration_ms', num('mean_task_duration', 1)), ('max_task_duration_ms', 'max_task_duration'), ('min_task_duration_ms', 'min_task_duration'), ('duration_range_ms', '(max_task_duration - min_task_duration)'), ('slowest_vs_fastest_ratio', num('max_task_duration / min_task_duration', 2) + " || 'x'"), ('total_tasks', 'total_tasks')])}
  WHEN 'bn_cpu_underuse' THEN {_sup([('cpu_efficiency_percentage', pct('cpu_efficiency', 2)), ('cpu_waste_percentage', pct('(1 - cpu_efficiency)', 2))])}
  WHEN 'bn_memory_spill' THEN {_sup([('memory_spilled_bytes', 'memory_bytes_spilled'), ('memory_spilled_formatted', fbytes('memory_bytes_spilled')), ('spill_ratio_percentage', pct('spill_ratio', 2))])}
  END"""
_FIRST = {"bn_gc_pressure": f"'Increase executor memory: spark.executor.memory (current impact: ' || {pct('gc_overhead_ratio')} || ' GC time)'",
          "bn_cpu_underuse": f"'Increase cores per executor: spark.executor.cores (current utilization: ' || {pct('cpu_efficiency')} || ')'"}


def _actions(k, c):
    items = [_FIRST[k]] if k in _FIRST else []
    return "[" + ", ".join(items + ["'" + a.replace("'", "''") + "'" for a in c.actions]) + "]"


_ACTIONS = "CASE detector " + " ".join(f"WHEN '{k}' THEN {_actions(k, c)}" for k, c in H.CAUSES.items()) + " END"
CAUSE_CTES = f"""
rcf AS (SELECT *, {DET} AS detector FROM fd),
rcx AS (SELECT app_id, {_CAUSE} AS root_cause, detector, severity, confidence, {_SUPPORT} AS supporting_metrics, {_REC} AS recommendation, {_ACTIONS} AS action_items
    FROM rcf JOIN m USING (app_id)),
rcn AS (SELECT m.app_id, count(fd.app_id) AS n FROM m LEFT JOIN fd ON fd.app_id = m.app_id GROUP BY 1),
rco AS (SELECT app_id, 'System Overview' AS root_cause, 'overview' AS detector, 'INFO' AS severity, CAST(1 AS DOUBLE) AS confidence,
    'total_tasks=' || total_tasks || '; total_input_data=' || {fbytes('input_bytes')} || '; total_output_data=' || {fbytes('output_bytes')} || '; total_shuffle_data=' ||
    {fbytes(_SHUF)} || '; identified_bottlenecks=' || n AS supporting_metrics,
    'Found ' || n || ' performance bottleneck(s). Review and address in priority order above.' AS recommendation, CAST([] AS VARCHAR[]) AS action_items
    FROM m JOIN rcn USING (app_id) WHERE n > 0),
rch AS (SELECT app_id, '{H.HEALTHY[0]}' AS root_cause, 'healthy' AS detector, CAST(NULL AS VARCHAR) AS severity, CAST(1 AS DOUBLE) AS confidence,
    'cpu_efficiency=' || {pct('cpu_efficiency', 2)} || '; gc_overhead=' || {pct('gc_overhead_ratio', 2)} || '; task_count=' || total_tasks || '; avg_task_duration_ms=' ||
    {num('mean_task_duration', 2)} AS supporting_metrics, '{H.HEALTHY[1]}' AS recommendation, CAST([] AS VARCHAR[]) AS action_items FROM m JOIN rcn USING (app_id) WHERE n = 0),
rca AS (SELECT * FROM rcx UNION ALL SELECT * FROM rco UNION ALL SELECT * FROM rch)"""
_RC = f"app_id, root_cause, detector, severity, {r6('confidence')} AS confidence, supporting_metrics, recommendation, array_to_string(action_items, ' | ') AS action_items"


def cq(sql: str, *extra: str) -> str:
    return query(sql, FINDING_CTES, CAUSE_CTES, *extra)


def metrics(s, d, *groups):
    return M.app_metrics(BenchCorpus(s, d), *groups)


CAUSE_NEEDS = tuple(dict.fromkeys((*D.needs(), "io")))


def _flat(df):
    return df.selectExpr("* EXCEPT (supporting_metrics, action_items)", f"{map_text('supporting_metrics')} AS supporting_metrics", "array_join(action_items, ' | ') AS action_items")


register("root_causes", lambda s, d: _flat(H.root_causes(metrics(s, d, *CAUSE_NEEDS))), cq(f"SELECT {_RC} FROM rcx"))
register("root_cause_healthy", lambda s, d: _flat(H.root_cause_healthy(metrics(s, d, *CAUSE_NEEDS))), cq(f"SELECT {_RC} FROM rch"))
register("system_overview", lambda s, d: _flat(H.system_overview(metrics(s, d, *CAUSE_NEEDS))), cq(f"SELECT {_RC} FROM rco"))
register("recommendation_text", lambda s, d: H.recommendation_texts(metrics(s, d, "gc", "shuffle", "task", "cpu", "executors", "spill")), cq(
    " UNION ALL ".join(f"SELECT app_id, '{k}' AS detector, {v} AS recommendation FROM m" for k, v in RECS.items())))

# --- chains -------------------------------------------------------------------
_WIDE = "('join', 'groupBy', 'shuffle', 'wide')"
_PR = "n_exec > 0 AND n_oom > 0 AND (gc_ratio > 0.2 OR total_memory_spilled > 0)"
_FE = "n_fetch > 0 AND contains(failure_reason, 'FetchFailed')"
_PL = f"n_exec = 0 AND NOT ({_FE})"
_SPILLED = fbytes("total_memory_spilled", True)


def _l(pos, event, **metrics):
    body = " || '; ' || ".join(f"'{k}=' || {v}" for k, v in metrics.items()) or "''"
    return f"{pos} AS pos, {event} AS event, {body} AS met"


_FL = [
    ("true", _l(1, "'Stage ' || stage_id || ' failed'")),
    ("n_exec > 0", _l(2, "'Executor(s) lost: ' || n_exec || ' executor failure(s)'", failed_executors="n_exec")),
    ("n_exec > 0 AND n_oom > 0", _l(3, "'Out of Memory (OOM) detected'", oom_count="n_oom")),
    (_PR, _l(4, "'High memory pressure detected'", gc_overhead=pct("gc_ratio"), memory_spilled=_SPILLED)),
    (_PR, _l(5, "'ROOT CAUSE: Insufficient executor memory'", recommendation="'Increase spark.executor.memory'")),
    (_FE, _l(6, "'Shuffle fetch failure: ' || n_fetch || ' fetch failure(s)'", fetch_failures="n_fetch")),
    (f"{_FE} AND shuffle_ratio > 0.5", _l(7, "'Heavy shuffle operations detected'", shuffle_ratio=pct("shuffle_ratio"))),
    (f"{_FE} AND shuffle_ratio > 0.5", _l(8, "'ROOT CAUSE: Network instability or shuffle service issues'", recommendation="'Enable external shuffle service, reduce shuffle volume'")),
    (f"{_PL} AND gc_ratio > 0.3", _l(9, "'Critical GC overhead detected'", gc_overhead=pct("gc_ratio"))),
    (f"{_PL} AND gc_ratio > 0.3", _l(10, "'ROOT CAUSE: Memory pressure / GC thrashing'", recommendation="'Increase executor memory and tune GC'")),
    (f"{_PL} AND gc_ratio <= 0.3 AND task_skew > 1", _l(11, "'Severe data skew detected'", task_skew=num("task_skew", 2))),
    (f"{_PL} AND gc_ratio <= 0.3 AND task_skew > 1", _l(12, "'ROOT CAUSE: Uneven data distribution'", recommendation="'Repartition data and handle skewed keys'")),
    (f"{_PL} AND gc_ratio <= 0.3 AND task_skew <= 1", _l(13, "'ROOT CAUSE: Unknown - Review stage logs for details'", recommendation="'Check application logs and Spark UI'")),
]
_PF = [
    ("HIGH_GC", "true", _l(1, "'Stage ' || stage_id || ' experiencing high GC overhead'", gc_overhead=pct("gc_ratio"))),
    ("HIGH_GC", "total_memory_spilled > 0", _l(2, "'Memory spill detected'", memory_spilled=_SPILLED)),
    ("HIGH_GC", "true", _l(3, "'ROOT CAUSE: Insufficient memory allocation'", recommendation="'Increase spark.executor.memory by 30-50%'")),
    ("DATA_SKEW", "true", _l(1, "'Stage ' || stage_id || ' has uneven task distribution'", task_skew=num("task_skew", 2), max_task_duration=num("max_task_duration_ms", 0) + " || 'ms'",
                             mean_task_duration=num("mean_task_duration_ms", 0) + " || 'ms'")),
    ("DATA_SKEW", f"transformation_type IN {_WIDE}", _l(2, "'Wide transformation detected: ' || operation", transformation_type="transformation_type")),
    ("DATA_SKEW", "true", _l(3, "'ROOT CAUSE: Data skew in partition distribution'", recommendation="'Enable AQE skew handling or use salting technique'")),
    ("MEMORY_SPILL", "true", _l(1, "'Stage ' || stage_id || ' spilling data to disk'", memory_spilled=_SPILLED)),
    ("MEMORY_SPILL", "true", _l(2, "'Memory pressure exceeds available executor memory'", gc_overhead=pct("gc_ratio"))),
    ("MEMORY_SPILL", "true", _l(3, "'ROOT CAUSE: Working set too large for memory'", recommendation="'Increase executor memory or reduce data volume per partition'")),
    ("EXCESSIVE_SHUFFLE", "true", _l(1, "'Stage ' || stage_id || ' has heavy shuffle operations'", shuffle_ratio=pct("shuffle_ratio"), shuffle_data=fbytes("total_shuffle_read", True))),
    ("EXCESSIVE_SHUFFLE", "true", _l(2, "'Transformation causing shuffle: ' || operation", transformation_type="transformation_type")),
    ("EXCESSIVE_SHUFFLE", "true", _l(3, "'ROOT CAUSE: Inefficient shuffle strategy'", recommendation="'Use broadcast join for small tables or reduce shuffle partitions'")),
]


def _chain_ctes(exec_source: str) -> str:
    links = [f"SELECT app_id, stage_id, {x} FROM cs WHERE status = 'FAILED' AND {c}" for c, x in _FL]
    links += [f"SELECT app_id, stage_id, {x} FROM cs WHERE status <> 'FAILED' AND first_type = '{k}' AND {c}" for k, c, x in _PF]
    return f"""
cs AS (SELECT sd.*, fst.type AS first_type, {exec_source} AS n_exec, fc.total_oom_events AS n_oom, fc.total_fetch_failures AS n_fetch, m.gc_vs_duration, m.spill_vs_gc
    FROM sd JOIN fc USING (app_id) JOIN m USING (app_id)
    LEFT JOIN (SELECT app_id, stage_id, arg_min(type, ord) AS type FROM si GROUP BY 1, 2) fst USING (app_id, stage_id)),
cl AS ({' UNION ALL '.join(links)}),
cg AS (SELECT app_id, stage_id, string_agg(event || ' {{' || met || '}}', ' -> ' ORDER BY pos) AS chain, count(*) AS n, bool_or(met <> '') AS has_met,
    bool_or(contains(event, 'ROOT CAUSE')) AS has_root FROM cl GROUP BY 1, 2),
sy AS (SELECT app_id, stage_id, arg_min(type, k) AS type, arg_min(severity, k) AS severity, arg_min(description, k) AS description
    FROM (SELECT *, least(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, 2) * 10 + ord AS k FROM si) GROUP BY 1, 2),
ch AS (SELECT cs.app_id, cs.stage_id, cs.stage_name, cs.status,
    CASE WHEN status = 'FAILED' THEN 'STAGE_FAILURE' ELSE coalesce(sy.type, 'NO_ISSUE') END AS symptom_type,
    CASE WHEN status = 'FAILED' THEN 'CRITICAL' ELSE coalesce(sy.severity, 'INFO') END AS symptom_severity,
    CASE WHEN status = 'FAILED' THEN 'Stage failed: ' || coalesce(failure_reason, 'Unknown') ELSE coalesce(sy.description, 'Stage completed successfully') END AS symptom_text,
    coalesce(chain, '') AS chain, coalesce(cg.n, 0) AS links, CASE WHEN cg.n IS NULL THEN 0 ELSE least(0.5 + least(cg.n * 0.1, 0.3) + CASE WHEN has_met THEN 0.15 ELSE 0 END
      + CASE WHEN has_root THEN 0.1 ELSE 0 END, 1) END AS confidence,
    'GC Overhead %=' || {pct('gc_ratio')} || '; Task Skew Ratio=' || {num('task_skew', 2)} || '; Memory Spilled=' || {_SPILLED} || '; Shuffle Read=' ||
    {fbytes('total_shuffle_read', True)} || '; Total Duration=' || {fdur('total_duration_ms')} || '; Task Count=' || total_tasks || '; Mean Task Duration=' ||
    {num('mean_task_duration_ms', 0)} || 'ms; Max Task Duration=' || {num('max_task_duration_ms', 0)} || 'ms; GC vs Duration Correlation=' || {num('gc_vs_duration', 3)} ||
    '; Spill vs GC Correlation=' || {num('spill_vs_gc', 3)} AS correlated_metrics
    FROM cs LEFT JOIN cg USING (app_id, stage_id) LEFT JOIN sy USING (app_id, stage_id))"""


CHAIN_CTES = _chain_ctes("fc.total_executor_failures")
NEAR_MS = 86400000 * 3
NEAR_CTES = _chain_ctes(f"(SELECT count(*) FROM ef WHERE ef.app_id = sd.app_id AND sd.status = 'FAILED' AND abs(ef.timestamp_ms - sd.completion_ms) <= {NEAR_MS})")


def hq(sql: str, ctes: str = CHAIN_CTES) -> str:
    return query(sql, STAGE_CTES, FAILURE_CTES, ctes)


def chains(s, d, within_ms=None):
    c = BenchCorpus(s, d)
    details = S.stage_details(c.stages, c.tasks, c.task_parts)
    near = H.nearby_executor_failures(details, c.executor_events, within_ms) if within_ms else None
    correlations = M.metrics_of_parts(c.task_parts, "corr")
    return H.cause_chains(details, G.failure_counts(c.tasks, c.stages, c.executor_events, c.task_parts), correlations, near)


CHAIN = f"array_join(transform(chain, l -> concat(l.event, ' {{', {map_text('l.metrics')}, '}}')), ' -> ') AS chain"
SYM = ("symptom.type AS symptom_type", "symptom.severity AS symptom_severity", "symptom.description AS symptom_text")
_SQL_CHAIN = f"app_id, stage_id, symptom_type, chain, links, {r6('confidence')} AS confidence"


def _chain_view(df):
    return df.selectExpr("app_id", "stage_id", SYM[0], CHAIN, "size(chain) AS links", "confidence")


register("primary_symptom", lambda s, d: H.primary_symptom(S.stage_details(BenchCorpus(s, d).stages, BenchCorpus(s, d).tasks)).selectExpr("app_id", "stage_id", *SYM), hq(
    "SELECT app_id, stage_id, symptom_type, symptom_severity, symptom_text FROM ch"))
register("failure_chain", lambda s, d: _chain_view(chains(s, d).filter("status = 'FAILED'")), hq(f"SELECT {_SQL_CHAIN} FROM ch WHERE status = 'FAILED'"))
SPANS = {"1 s": 1000, "1 h": 3_600_000, "3 d": NEAR_MS}


def _near(s, d):
    """Tasks that ended close to the end of a failed stage, for three widths."""
    c = BenchCorpus(s, d)
    ends = S.stage_details(c.stages, c.tasks).filter("status = 'FAILED' AND completion_ms IS NOT NULL")
    spans = ends.selectExpr("app_id", "stage_id", "completion_ms", "explode(array(" + ", ".join(f"struct('{name}' AS within, {ms}L AS ms)" for name, ms in SPANS.items()) + ")) AS w")
    counted = H.counted_between(c.tasks.selectExpr("app_id", "finish_ms AS ts_ms"), spans.selectExpr("app_id", "stage_id", "w.within", "completion_ms - w.ms AS lo", "completion_ms + w.ms AS hi"))
    return counted.selectExpr("within", "app_id", "stage_id", "n AS tasks_ended")


register("tasks_near_failure", _near, hq(" UNION ALL ".join(
    f"""SELECT '{name}' AS within, app_id, stage_id, (SELECT count(*) FROM tasks t WHERE t.app_id = sd.app_id AND abs(t.finish_ms - sd.completion_ms) <= {ms}) AS tasks_ended
    FROM sd WHERE status = 'FAILED' AND completion_ms IS NOT NULL""" for name, ms in SPANS.items())))
register("failure_chain_nearby", lambda s, d: _chain_view(chains(s, d, NEAR_MS).filter("status = 'FAILED'")), hq(f"SELECT {_SQL_CHAIN} FROM ch WHERE status = 'FAILED'", NEAR_CTES))
register("performance_chain", lambda s, d: _chain_view(chains(s, d).filter("status <> 'FAILED' AND size(issues) > 0")), hq(
    f"SELECT {_SQL_CHAIN} FROM ch WHERE status <> 'FAILED' AND symptom_type <> 'NO_ISSUE'"))
register("chain_correlated_metrics", lambda s, d: chains(s, d).selectExpr("app_id", "stage_id", f"{map_text('correlated_metrics')} AS correlated_metrics"), hq(
    "SELECT app_id, stage_id, correlated_metrics FROM ch"))
register("chain_confidence", lambda s, d: chains(s, d).selectExpr("app_id", "stage_id", "size(chain) AS links", "confidence"), hq(
    f"SELECT app_id, stage_id, links, {r6('confidence')} AS confidence FROM ch"))
register("explore_failures", lambda s, d: H.explore_failures(chains(s, d)).selectExpr("app_id", "stage_id", "stage_name", "status", CHAIN, "confidence"), hq(
    f"""SELECT app_id, stage_id, stage_name, status, chain, {r6('confidence')} AS confidence FROM ch
    WHERE EXISTS (SELECT 1 FROM si WHERE si.app_id = ch.app_id AND si.stage_id = ch.stage_id AND severity = 'CRITICAL')"""))
register("chain_report_lines", lambda s, d: H.chain_report_lines(H.explore_failures(chains(s, d))))
register("cause_chain_for_stage", lambda s, d: chains(s, d).selectExpr("app_id", "stage_id", "stage_name", *SYM, CHAIN, "confidence", f"{map_text('correlated_metrics')} AS correlated_metrics"), hq(
    f"SELECT app_id, stage_id, stage_name, symptom_type, symptom_severity, symptom_text, chain, {r6('confidence')} AS confidence, correlated_metrics FROM ch"))
_CAND = " UNION ALL ".join(
    f"SELECT app_id, '{s}' AS symptom, {n} AS occurrences, '{','.join(m)}' AS check_metrics, unnest({list(c)}) AS probable_cause FROM fc WHERE {n} > 0" for s, n, m, c in H.CANDIDATES)
register("cause_candidates", lambda s, d: H.cause_candidates(G.failure_counts(BenchCorpus(s, d).tasks, BenchCorpus(s, d).stages, BenchCorpus(s, d).executor_events)).selectExpr(
    "* EXCEPT (check_metrics)", "array_join(check_metrics, ',') AS check_metrics"), query(_CAND, STAGE_CTES, FAILURE_CTES))

# --- rules ----------------------------------------------------------------------------------------
_RULES = ", ".join(f"('{n}', '{dt}', {b}, {len(ps)}, '{m}', '{op}', {t})" for n, dt, b, ps in R.RULES for m, op, t in ps)
_THR = ", ".join(f"('{s}', '{m}', {t})" for s, ms in R.THRESHOLDS.items() for m, t in ms.items())
_RECROWS = ", ".join("('" + r.replace("'", "''") + f"', '{s}', {i}, '" + t.replace("'", "''") + "')" for r, by in R.RECOMMENDATIONS.items() for s, ts in by.items() for i, t in enumerate(ts))
RULE_CTES = f"""
ru(rule, detector, boost, total, metric, op, threshold) AS (VALUES {_RULES}),
th(severity, metric, threshold) AS (VALUES {_THR}),
rr(rule, severity, position, recommendation) AS (VALUES {_RECROWS}),
rv AS (SELECT app_id, rule, detector, CAST(boost AS DOUBLE) AS boost, count(*) FILTER (CASE op WHEN '>' THEN value > threshold ELSE value < threshold END) AS matched, CAST(total AS BIGINT) AS total
    FROM ml JOIN ru USING (metric) GROUP BY ALL),
rs AS (SELECT app_id, metric, max(value) AS value, CAST(min({rank('severity')}) AS BIGINT) AS sev_rank FROM ml JOIN th USING (metric)
    WHERE CASE WHEN metric = 'cpu_efficiency' THEN value < threshold ELSE value > threshold END GROUP BY 1, 2)"""


def rq(sql: str) -> str:
    return query(sql, LONG_CTE, FINDING_CTES, RULE_CTES)




def _long(s, d):
    return M.metrics_long(metrics(s, d))


register("rules_eval", lambda s, d: R.rules_eval(_long(s, d), R.rules_table(s)).select("app_id", "rule", "matched", "total", "fires"), rq(
    "SELECT app_id, rule, matched, total, matched = total AS fires FROM rv"))
register("severity_from_thresholds", lambda s, d: R.severity_from_thresholds(_long(s, d), R.thresholds_table(s)), rq(
    f"SELECT app_id, metric, {r6('value')} AS value, sev_rank, ['CRITICAL', 'HIGH', 'MEDIUM'][sev_rank + 1] AS severity FROM rs"))
register("rule_recommendations", lambda s, d: R.rule_recommendations(_long(s, d), R.rules_table(s), R.thresholds_table(s), R.recommendations_table(s)), rq(
    """SELECT f.app_id, f.rule, f.severity, CAST(rr.position AS BIGINT) AS position, rr.recommendation FROM
    (SELECT rv.app_id, rv.rule, ['CRITICAL', 'HIGH', 'MEDIUM'][coalesce(min(rs.sev_rank), 2) + 1] AS severity FROM rv JOIN ru ON ru.rule = rv.rule
     LEFT JOIN rs ON rs.app_id = rv.app_id AND rs.metric = ru.metric WHERE rv.matched = rv.total GROUP BY 1, 2) f JOIN rr ON rr.rule = f.rule AND rr.severity = f.severity"""))


def _rule_confidence(s, d):
    m = Diagnosis(BenchCorpus(s, d)).metrics
    return R.rule_confidence(R.rules_eval(M.metrics_long(m), R.rules_table(s)), D.bottlenecks(m))


register("rule_confidence", _rule_confidence, rq(
    f"""SELECT app_id, rule, detector, matched, total, matched = total AS fires, {r6('confidence')} AS confidence, {r6('boost')} AS boost,
    {r6('CASE WHEN matched = total THEN least(1, confidence + boost) ELSE confidence END')} AS boosted_confidence,
    {r6("least(1, 0.5 + 0.5 * (0.35 * impact_score + 0.25 * least(correlation, 1) + 0.20 * CASE WHEN has_evidence THEN 1 ELSE 0 END + 0.20 * (matched / total)))")} AS calibrated_confidence
    FROM rv JOIN (SELECT *, {DET} AS detector FROM fd) USING (app_id, detector) WHERE matched > 0"""))
