"""Statistics that survive one group holding most of the rows: exact quantiles, and mergeable sketches of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

#: Values are split twice, into buckets of relative width 2**-COARSE and then 2**-FINE: a group has a few thousand
#: coarse buckets, a coarse bucket at most 2**(FINE - COARSE) fine ones, whatever the rows and the range of values.
COARSE, FINE = 7, 24


def _bucket(bits: int) -> str:
    """A number that rises with ``value``: its exponent, then the ``bits`` bits after the leading one; mirrored below zero."""
    e = "CAST(greatest(floor(log2(abs(value))), -900) AS BIGINT)"
    return f"CASE WHEN value = 0 THEN 0L ELSE CAST(sign(value) AS BIGINT) * (({e} + 1100L) * {2 ** (bits + 1)}L + CAST(floor(abs(value) * power(2D, {bits} - {e})) AS BIGINT)) END"


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, coarse, fine, value, n): how often each finite value comes, as doubles, counted once and stored.

    Partial aggregation shrinks hot groups before the shuffle, and the shuffle key contains the value, so no group lands in
    one task. Null and other values are left out.
    """
    rows = df.selectExpr(*keys, f"CAST({value} AS DOUBLE) AS value").filter("value IS NOT NULL AND abs(value) < double('Infinity')")
    counts = stash(rows.groupBy(*keys, "value").agg(F.count("*").alias("n")))
    return counts.selectExpr(*keys, f"{_bucket(COARSE)} AS coarse", f"{_bucket(FINE)} AS fine", "value", "n")


def grouped_quantiles(counts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group from ``value_counts``.

    Cumulated counts over coarse buckets say which of them hold the wanted ranks; those are split into fine buckets, and only
    the values of the fine buckets with a wanted rank are cumulated one by one. Keys must not be null.
    """
    by = ", ".join(keys)

    def hit(width: str) -> str:
        return f"filter(targets, t -> t.rank >= before AND t.rank < before + {width}) AS targets"

    wanted = ", ".join(
        f"named_struct('name', '{name}', 'side', '{side}', 'rank', {rank}, 'frac', {p}D * (total - 1) - floor({p}D * (total - 1)))"
        for name, p in probs.items()
        for side, rank in (("lo", f"floor({p}D * (total - 1))"), ("hi", f"least(floor({p}D * (total - 1)) + 1, total - 1)")))
    coarse = counts.groupBy(*keys, "coarse").agg(F.sum("n").alias("bn")).selectExpr(
        *keys, "coarse", "bn", f"coalesce(sum(bn) OVER (PARTITION BY {by} ORDER BY coarse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        f"sum(bn) OVER (PARTITION BY {by}) AS total").selectExpr("*", f"array({wanted}) AS targets").selectExpr(*keys, "coarse", "before", hit("bn")).filter("size(targets) > 0")
    fine = counts.join(coarse, [*keys, "coarse"]).groupBy(*keys, "coarse", "fine").agg(F.sum("n").alias("bn"), F.any_value("before").alias("first"), F.any_value("targets").alias("targets")).selectExpr(
        *keys, "fine", "bn", f"first + coalesce(sum(bn) OVER (PARTITION BY {by}, coarse ORDER BY fine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", "targets").selectExpr(
        *keys, "fine", "before", hit("bn")).filter("size(targets) > 0")
    picked = counts.join(fine, [*keys, "fine"]).selectExpr(
        *keys, "value", "n", f"before + sum(n) OVER (PARTITION BY {by}, fine ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto", "targets"
    ).selectExpr(*keys, "value", "explode(filter(targets, t -> t.rank < upto AND t.rank >= upto - n)) AS t").selectExpr(*keys, "value", "t.name", "t.side", "t.frac")
    lo, hi, frac = ("max({0}) FILTER (WHERE name = '{{n}}'{1})".format(*x) for x in (("value", " AND side = 'lo'"), ("value", " AND side = 'hi'"), ("frac", "")))
    return picked.groupBy(*keys).agg(*[F.expr(f"{lo.format(n=n)} + ({hi.format(n=n)} - {lo.format(n=n)}) * {frac.format(n=n)} AS {n}") for n in probs])


#: Size of a rank sketch.
SKETCH = 2048


def rank_error(k: int = SKETCH) -> float:
    """Share of the rows by which a rank of a sketch of size ``k`` may be off, met in at least 99 of 100 cases (a property of KLL sketches)."""
    return 2.296 / k ** 0.9021


def rank_sketches(df: DataFrame, keys: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """(keys, sketch) of the finite values of each group: a few kilobytes that can be stored, and merged with those of other rows."""
    rows = df.selectExpr(*keys, f"CAST({value} AS DOUBLE) AS value").filter("value IS NOT NULL AND abs(value) < double('Infinity')")
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str], k: int = SKETCH) -> DataFrame:
    """Sketches of finer groups, or of logs that came later, put together without their rows."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, total, one column for each quantile): values whose ranks are off by ``rank_error`` at most."""
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("total"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(p).cast("double")).alias(n) for n, p in probs.items()))


def guarded_corr(x: str, y: str) -> str:
    """Pearson correlation, 0 for a constant column (plain corr would divide by zero)."""
    x, y = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return f"coalesce(try_divide(covar_samp({x}, {y}), stddev_samp({x}) * stddev_samp({y})), 0D)"
