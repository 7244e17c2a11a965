"""Spark SQL expression builders: formatting, severities and failure classes.

Every helper takes SQL expressions as text and returns one, so an operator is a
handful of ``selectExpr`` calls (one JVM call each) and the whole computation
stays in generated code.  ``col(fn(...))`` turns any of them into a Column.

``format_number`` is given an explicit pattern because its half-even rounding
agrees with the printf of other tools; ``format_string`` rounds half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, severities, failure patterns, stage name patterns ------
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

FAILURE_PATTERNS = (
    ("OOM", "OutOfMemoryError|Java heap space|GC overhead limit exceeded"),
    ("FetchFailed", "FetchFailed|ShuffleFetchFailed"),
    ("ExecutorLost", "ExecutorLostFailure|Executor .* lost"),
    ("NetworkIssue", "Connection refused|Connection reset|IOException"),
    ("DiskFull", "No space left on device|Disk full"),
    ("Timeout", "TimeoutException|Timeout waiting"),
)

EXECUTOR_FAILURE_WORDS = ("lost", "failed", "killed", "error")

TRANSFORMATIONS = (
    ("join", ("join", "leftOuterJoin", "rightOuterJoin", "fullOuterJoin")),
    ("groupBy", ("groupBy", "groupByKey", "aggregateByKey")),
    ("shuffle", ("repartition", "coalesce", "sortBy", "sortByKey")),
    ("cache", ("cache", "persist")),
    ("wide", ("reduceByKey", "combineByKey", "distinct")),
)

WIDE_TYPES = ("join", "groupBy", "shuffle", "wide")
# -----------------------------------------------------------------------------


def col(expression: str) -> Column:
    return F.expr(expression)


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num(x: str, digits: int) -> str:
    """Number as text with a fixed count of decimals and no grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return f"format_number(CAST({x} AS DOUBLE), '{pattern}')"


def percent(x: str, digits: int = 1) -> str:
    return f"concat({num(f'CAST({x} AS DOUBLE) * 100D', digits)}, '%')"


def times(x: str, digits: int = 1) -> str:
    return f"concat({num(x, digits)}, 'x')"


def format_bytes(x: str, short_zero: bool = False) -> str:
    """Bytes in base 1024 with two decimals, from B to PB."""
    v = f"CAST({x} AS DOUBLE)"
    zero = f"WHEN {v} = 0 THEN '0 B' " if short_zero else ""
    arms = " ".join(f"WHEN {v} < {1024.0 ** (k + 1)}D THEN concat({num(f'{v} / {1024.0 ** k}D', 2)}, ' {BYTE_UNITS[k]}')" for k in range(5))
    return f"CASE {zero}{arms} ELSE concat({num(f'{v} / {1024.0 ** 5}D', 2)}, ' PB') END"


def format_duration(x: str, seconds_in_hours: bool = False) -> str:
    """Milliseconds as ``ms``, ``s``, ``m s`` or ``h m`` (optionally ``h m s``)."""
    ms = f"CAST({x} AS DOUBLE)"
    whole = f"CAST({ms} / 1000D AS BIGINT)"
    tail = f", ' ', {whole} % 60, 's'" if seconds_in_hours else ""
    return (f"CASE WHEN {ms} < 1000 THEN concat({num(ms, 0)}, 'ms') WHEN {ms} < 60000 THEN concat({num(f'{ms} / 1000D', 1)}, 's') "
            f"WHEN {ms} < 3600000 THEN concat({whole} div 60, 'm ', {whole} % 60, 's') "
            f"ELSE concat({whole} div 3600, 'h ', ({whole} div 60) % 60, 'm'{tail}) END")


def severity_rank(x: str) -> str:
    """CRITICAL 0, HIGH 1, MEDIUM 2, LOW 3, anything else 4."""
    arms = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES))
    return f"CASE {x} {arms} ELSE 4 END"


def ladder(x: str, steps: list[tuple[float, str]], default: str) -> str:
    """Label of the first bound that is exceeded; bounds in falling order."""
    arms = " ".join(f"WHEN {x} > {bound}D THEN '{label}'" for bound, label in steps)
    return f"CASE {arms} ELSE '{default}' END"


def correlation_label(x: str) -> str:
    return ladder(x, [(0.7, "STRONG"), (0.4, "MODERATE")], "WEAK")


def shuffle_correlation_label(x: str) -> str:
    return ladder(x, [(0.5, "HIGH"), (0.3, "MODERATE")], "LOW")


def classify_failure(x: str) -> str:
    """First matching failure class in declaration order, else UNKNOWN."""
    arms = " ".join(f"WHEN {x} RLIKE '(?i){p}' THEN '{n}'" for n, p in FAILURE_PATTERNS)
    return f"CASE {arms} ELSE 'UNKNOWN' END"


def matches_failure(x: str, name: str) -> str:
    return f"coalesce({x} RLIKE '(?i){dict(FAILURE_PATTERNS)[name]}', false)"


def is_executor_failure(x: str) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in EXECUTOR_FAILURE_WORDS) + ", false)"


def transformation(stage_name: str) -> str:
    """struct(type, operation): the last matching type and its first matching pattern."""
    low = f"lower(coalesce({stage_name}, ''))"
    arms = " ".join(f"WHEN contains({low}, '{p.lower()}') THEN named_struct('type', '{kind}', 'operation', '{p}')"
                    for kind, patterns in reversed(TRANSFORMATIONS) for p in patterns)
    return f"CASE {arms} ELSE named_struct('type', 'unknown', 'operation', 'unknown') END"


def ratio(a: str, b: str) -> str:
    """a / b as a double, 0 where b is 0 or either is missing."""
    return f"coalesce(try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0D)"


def links(*pairs: tuple[str, str]) -> str:
    """Ordered array of the values whose condition holds."""
    return "filter(array(" + ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in pairs) + "), x -> x IS NOT NULL)"


def str_map(**pairs: str) -> str:
    """MAP<STRING,STRING> in the given key order; values are expressions."""
    if not pairs:
        return "CAST(map() AS MAP<STRING,STRING>)"
    return "map(" + ", ".join(f"'{k.replace('__', ' ')}', CAST({v} AS STRING)" for k, v in pairs.items()) + ")"


def map_text(m: str) -> str:
    """A map as one line ``k=v; k=v``, in the order in which it was built."""
    return f"array_join(transform(map_entries({m}), e -> concat(e.key, '=', coalesce(e.value, ''))), '; ')"
