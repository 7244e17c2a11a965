"""Query registry: one callable per inventory key, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def canon(df: DataFrame) -> DataFrame:
    """Doubles to six digits, small integers to BIGINT, so both engines give equal types and values."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "double":
            out.append(f"round(`{f.name}`, 6) + 0D AS `{f.name}`")
        elif kind in ("integer", "short", "byte"):
            out.append(f"CAST(`{f.name}` AS BIGINT) AS `{f.name}`")
        else:
            out.append(f"`{f.name}`")
    return df.selectExpr(*out)


def register(key: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"duplicate key {key}")
    QUERIES[key] = lambda spark, sf_dir: canon(fn(spark, sf_dir))
    if sql is not None:
        ORACLES[key] = sql


def load() -> None:
    from eventlens.bench import reg_causes, reg_detectors, reg_executors, reg_failures, reg_metrics, reg_report, reg_sources, reg_stages, reg_stream  # noqa: F401
