"""Registered queries against their SQL on the smallest driver tables (tools/check_oracle.py runs all of them)."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
KEYS = ["task_percentiles", "stragglers_iqr", "rollup_metrics", "stage_table", "stage_issues", "job_metrics", "executor_stats", "bn_shuffle", "task_hotspots",
        "failure_summary", "root_causes", "failure_chain_nearby", "rules_eval", "executive_summary", "task_extract", "stream_task_windows"]


def rows(columns):
    def norm(v):
        return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    names = sorted(columns)
    return names, sorted((tuple(norm(v) for v in r) for r in zip(*[columns[n] for n in names])), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[key](spark, SF).toArrow().to_pydict()
    want = con.sql(entry.oracle_sql()[key]).to_arrow_table().to_pydict()
    assert rows(got) == rows(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
