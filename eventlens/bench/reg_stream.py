"""Registry of streaming queries and scalar functions."""

from pyspark.sql import functions as F

from eventlens.bench import logs
from eventlens.bench import views as v
from eventlens.bench.reg_sources import nq
from eventlens.bench.registry import register
from eventlens.bench.sqltext import classify, div, fbytes, fdur, num, pct, query, r6
from eventlens.functions import text as T
from eventlens.plans.stash import new_path
from eventlens.streaming import live


def _ingest(s, d):
    """Every event line; the logs come in three parts, and the stream starts again for each."""
    path = new_path(s, "live")
    store, mark = new_path(s, "stream-events"), new_path(s, "checkpoint")
    for part in range(3):
        logs.write_events(s, d, path, only=f"CAST(substr(app_id, 5) AS INT) % 3 = {part}")
        live.ingest(s, path, store, mark)
    return s.read.parquet(store).groupBy("event_type", "is_valid").count()


register("stream_ingest", _ingest, nq(
    "SELECT event AS event_type, ok AS is_valid, count(*) AS count FROM ev GROUP BY 1, 2"))


def _stream_tasks(s, d):
    rows = s.readStream.schema(v.SCHEMAS["lineitem"]).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    return v.tasks_from(rows)


def _windows(every, slide=None):
    def run(s, d):
        store = new_path(s, "windows")
        live.run_updates(live.task_windows(_stream_tasks(s, d), every, slide), store, new_path(s, "checkpoint"))
        return live.latest(s, store)

    return run


def _window_sql(width: int, slide: int) -> str:
    # every window of the width that holds the finish time starts at a multiple of the slide
    return query(f"""SELECT app_id, w AS window_start_ms, w + {width} AS window_end_ms, count(*) AS tasks, {r6('avg(duration_ms)')} AS mean_duration_ms, max(duration_ms) AS max_duration_ms,
    {r6(div('sum(cpu_ns) / 1e6', 'sum(run_ms)'))} AS cpu_efficiency, {r6(div('sum(gc_ms)', 'sum(run_ms)'))} AS gc_overhead_ratio
    FROM (SELECT *, unnest([(finish_ms // {slide} - k) * {slide} for k in range(0, {width // slide})]) AS w FROM tasks) GROUP BY 1, 2""")


DAY = 86400000
register("stream_task_windows", _windows("30 days"), _window_sql(30 * DAY, 30 * DAY))
register("stream_task_windows_sliding", _windows("30 days", "10 days"), _window_sql(30 * DAY, 10 * DAY))


def _counted(s, d):
    """The tasks in files that come in no order of time, a sixth of them to a micro-batch; every task that reads line items writes six."""
    source, store = new_path(s, "stream-tasks"), new_path(s, "counted")
    rows = v.tasks(s, d)
    rows.withColumn("part", F.expr("task_id % 6")).write.partitionBy("part").parquet(source)
    files = len(s.read.schema(rows.schema).parquet(source).inputFiles())
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // 6))).parquet(source)
    live.run_counted(stream, store, new_path(s, "checkpoint"), 30 * DAY, DAY)
    return live.counted_windows(s, store, 30 * DAY)


register("stream_counted_windows", _counted, _window_sql(30 * DAY, 30 * DAY))


def _loss(s, d):
    source, store = new_path(s, "executor-events"), new_path(s, "loss")
    events = v.executor_events(s, d)
    events.write.parquet(source)
    stream = s.readStream.schema(events.schema).parquet(source)
    live.run_append(live.executor_loss(stream), store, new_path(s, "checkpoint"))
    return s.read.schema("app_id STRING, window_start_ms BIGINT, window_end_ms BIGINT, removed BIGINT, heartbeat_timeouts BIGINT").parquet(store)


register("stream_executor_loss", _loss, query(
    """SELECT app_id, ts_ms // 3600000 * 3600000 AS window_start_ms, ts_ms // 3600000 * 3600000 + 3600000 AS window_end_ms, count(*) AS removed,
    count(*) FILTER (lower(reason) LIKE '%heartbeat%') AS heartbeat_timeouts FROM executor_events WHERE kind = 'REMOVED'
    GROUP BY 1, 2 HAVING window_end_ms <= (SELECT max(ts_ms) - 600000 FROM executor_events WHERE kind = 'REMOVED')"""))

# --- scalar functions over every line item ------------------------------------------------------
_SRC = ("SELECT l_orderkey AS k, l_linenumber AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, "
        "CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1000 WHEN 4 THEN 1000000 WHEN 5 THEN 100000000 ELSE 10000000000 END AS b, "
        "l_discount AS x, l_tax AS y, l_returnflag AS f")


def _items(s, d):
    df = v._read(s, d, "lineitem")
    return df.selectExpr(*[c.strip() for c in _SRC.removeprefix("SELECT ").replace("CASE l_linenumber", "CASE l_linenumber").split(", ")])


def _fn(*exprs):
    return lambda s, d: _items(s, d).selectExpr("k", "CAST(n AS BIGINT) AS n", *exprs)


def _fn_sql(*exprs):
    return f"SELECT k, CAST(n AS BIGINT) AS n, {', '.join(exprs)} FROM ({_SRC} FROM lineitem)"


register("format_bytes", _fn("b", f"{T.format_bytes('b')} AS text", f"{T.format_bytes('b', True)} AS short"), _fn_sql("b", f"{fbytes('b')} AS text", f"{fbytes('b', True)} AS short"))
register("format_duration", _fn("cents", f"{T.format_duration('cents')} AS text", f"{T.format_duration('cents', True)} AS long"), _fn_sql(
    "cents", f"{fdur('cents')} AS text", f"{fdur('cents', True)} AS long"))
register("format_percent", _fn(f"{T.percent('x')} AS one", f"{T.percent('y', 2)} AS two", f"{T.times('x * 7')} AS times"), _fn_sql(
    f"{pct('x')} AS one", f"{pct('y', 2)} AS two", f"{num('x * 7', 1)} || 'x' AS times"))
register("format_ratio", _fn(f"{T.num('x', 2)} AS two", f"{T.times('y * 11')} AS times"), _fn_sql(f"{num('x', 2)} AS two", f"{num('y * 11', 1)} || 'x' AS times"))
_SEV = "CASE WHEN x > 0.08{d} THEN 'CRITICAL' WHEN x > 0.06{d} THEN 'HIGH' WHEN x > 0.04{d} THEN 'MEDIUM' WHEN x > 0.02{d} THEN 'LOW' ELSE 'INFO' END"
register("severity_rank", _fn(f"{T.severity_rank(_SEV.format(d='D'))} AS rank"), _fn_sql(
    f"CAST(CASE {_SEV.format(d='')} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS BIGINT) AS rank"))
register("correlation_label", _fn(f"{T.correlation_label('x * 9D')} AS strength", f"{T.shuffle_correlation_label('x * 9D')} AS level"), _fn_sql(
    "CASE WHEN x * 9 > 0.7 THEN 'STRONG' WHEN x * 9 > 0.4 THEN 'MODERATE' ELSE 'WEAK' END AS strength", "CASE WHEN x * 9 > 0.5 THEN 'HIGH' WHEN x * 9 > 0.3 THEN 'MODERATE' ELSE 'LOW' END AS level"))
_MATH = ("round(exp({s}x), 6) AS e", "round(abs(y - x), 6) AS a", "least(x, y) AS lo", "greatest(x, y) AS hi", "round(x * 33.3{d}, 2) AS r")
register("math_fns", _fn(*[m.format(s="-", d="D") for m in _MATH], "CAST(cents / 7 AS BIGINT) AS t"), _fn_sql(*[m.format(s="-", d="") for m in _MATH], "cents // 7 AS t"))
_TXT = "concat_ws('. ', CASE f WHEN 'R' THEN 'Executor 7 lost' WHEN 'A' THEN 'TIMEOUT WAITING for reply' END, CASE WHEN n > 3 THEN 'no space left on device' END)"
register("string_fns", _fn(f"lower({_TXT}) AS low", f"contains({_TXT}, 'lost') AS has", f"{T.classify_failure(_TXT)} AS kind", f"left(repeat({_TXT}, 9), 200) AS cut"), _fn_sql(
    f"lower({_TXT}) AS low", f"contains({_TXT}, 'lost') AS has", f"{classify(_TXT)} AS kind", f"left(repeat({_TXT}, 9), 200) AS cut"))


def _collections(s, d):
    fine = _items(s, d).groupBy("k", "f").count()
    out = fine.groupBy("k").agg({"f": "collect_set", "count": "max"}).withColumnRenamed("collect_set(f)", "fs").withColumnRenamed("max(count)", "most")
    hist = fine.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "kinds")
    maps = fine.groupBy("k").pivot("f", ["A", "N", "R"]).sum("count")
    return out.join(hist, "k").join(maps, "k").selectExpr("k", "array_join(array_sort(fs), ',') AS flags", "kinds", "most",
                                                            "coalesce(element_at(map('A', A, 'N', N), 'A'), 0) AS a_count", "array_max(array(A, N, R)) AS top")


register("collection_fns", _collections, """SELECT k, string_agg(f, ',' ORDER BY f) AS flags, count(*) AS kinds, max(c) AS most, coalesce(max(c) FILTER (f = 'A'), 0) AS a_count, max(c) AS top
    FROM (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1""")


def _json(s, d):
    ev = v._read(s, d, "events")
    return ev.selectExpr("event_id", "from_json(props, 'k BIGINT').k AS k", "to_json(named_struct('id', event_id, 'type', event_type)) AS doc",
                         "try_variant_get(try_parse_json(props), '$.k', 'bigint') AS open_k", "try_variant_get(try_parse_json(props), '$.absent', 'string') AS absent")


register("json_fns", _json, """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc, CAST(props ->> '$.k' AS BIGINT) AS open_k,
    CAST(NULL AS VARCHAR) AS absent FROM events""")
