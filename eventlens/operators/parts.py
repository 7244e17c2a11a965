"""Task figures as mergeable parts: one row per (application, stage, executor).

A part holds counts, sums, extremes, and second moments about its own means, so that parts can be put together to any coarser
grain, or with those of a log that came later, without reading a task again. ``app_metrics``, stage and executor figures and failure
counts all follow from one table of parts, which costs a single pass over the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import matches_failure

KEYS = ["app_id", "stage_id", "executor_id"]

#: Columns whose sums are kept; of those in POSITIVE also the number of tasks above zero.
SUMMED = ("run_ms", "deser_ms", "gc_ms", "minor_gc_ms", "major_gc_ms", "heap_bytes", "offheap_bytes", "mem_spill_bytes", "disk_spill_bytes", "sh_read_bytes", "sh_write_bytes",
          "fetch_wait_ms", "sh_write_time", "sh_write_records", "in_bytes", "out_bytes", "in_records", "out_records", "duration_ms")
POSITIVE = ("mem_spill_bytes", "sh_read_bytes", "sh_write_bytes", "in_bytes", "out_bytes")
#: Columns with second moments, and the pairs with products.
MOMENTS = ("duration_ms", "gc_ms", "mem_spill_bytes", "fetch_wait_ms")
PRODUCTS = (("gc_ms", "duration_ms"), ("mem_spill_bytes", "gc_ms"), ("fetch_wait_ms", "duration_ms"))
_VALID = "CASE WHEN duration_ms > 0 THEN duration_ms END"

SUCCESS = '{"Reason":"Success"}'

#: Simple columns: name -> (expression over tasks, how two of them become one).
SIMPLE = {
    "n": ("count(1)", "sum"), "valid_n": (f"count({_VALID})", "sum"), "valid_sum": (f"coalesce(sum({_VALID}), 0)", "sum"),
    "valid_min": (f"min({_VALID})", "min"), "valid_max": (f"max({_VALID})", "max"), "max_heap": ("max(heap_bytes)", "max"), "max_offheap": ("max(offheap_bytes)", "max"),
    "cpu_time": ("coalesce(sum(CAST(cpu_ns AS DOUBLE)), 0D)", "sum"),
    **{f"sum_{c}": (f"coalesce(sum({c}), 0)", "sum") for c in SUMMED}, **{f"pos_{c}": (f"count_if({c} > 0)", "sum") for c in POSITIVE},
    "task_failures": ("count_if(end_reason IS NOT NULL AND end_reason <> 'Success')", "sum"),
    # the usual text is told from the others before any pattern is tried
    "task_oom": (f"count_if(end_reason_json <> '{SUCCESS}' AND {matches_failure('end_reason_json', 'OOM')})", "sum"),
    "fetch_failures": ("count_if(contains(end_reason, 'FetchFailed'))", "sum"),
}
#: Moments: name -> (expression over tasks, number, sum of x, sum of y). Figures of the canonical tasks are never null.
CENTRED = {
    "m2_valid": (f"coalesce(var_pop({_VALID}) * count({_VALID}), 0D)", "valid_n", "valid_sum", "valid_sum"),
    **{f"m2_{c}": (f"var_pop(coalesce({c}, 0)) * count(1)", "n", f"sum_{c}", f"sum_{c}") for c in MOMENTS},
    **{f"co_{x}_{y}": (f"covar_pop(coalesce({x}, 0), coalesce({y}, 0)) * count(1)", "n", f"sum_{x}", f"sum_{y}") for x, y in PRODUCTS},
}


def task_parts(tasks: DataFrame) -> DataFrame:
    """One part per (app_id, stage_id, executor_id)."""
    return tasks.groupBy(*KEYS).agg(*[F.expr(e[0]).alias(n) for n, e in {**SIMPLE, **CENTRED}.items()])


def combined(parts: DataFrame, keys: list[str], moments: bool = True) -> DataFrame:
    """Parts put together to the grain of ``keys``; the columns stay the same, so the result can be put together again.

    Second moments gain what the parts' means differ from the common mean, which is joined to the parts: no cancellation, so
    figures as far from zero as byte counts keep their digits. ``moments=False`` leaves them out and needs no join.
    """
    simple = [F.expr(f"{how}({n}) AS {n}") for n, (_, how) in SIMPLE.items()]
    if not moments:
        return parts.groupBy(*keys).agg(*simple)
    sums = sorted({s for _, n, a, b in CENTRED.values() for s in (n, a, b)})
    common = parts.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(*[F.sum(s).alias(f"all_{s}") for s in sums])

    def gap(total: str, number: str) -> str:
        """Difference of two means; whole numbers up to the division, so that figures far from zero keep their digits."""
        a, n, common_a, common_n = (f"CAST({x} AS DECIMAL(19, 0))" for x in (total, number, f"all_{total}", f"all_{number}"))
        return f"(CAST({a} * {common_n} - {common_a} * {n} AS DOUBLE) / {number} / all_{number})"

    centred = [F.expr(f"sum({m} + CASE WHEN {n} > 0 THEN {n} * {gap(a, n)} * {gap(b, n)} ELSE 0D END) AS {m}") for m, (_, n, a, b) in CENTRED.items()]
    return parts.join(common, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]).groupBy(*keys).agg(*simple, *centred)


def added(parts: DataFrame, more: DataFrame) -> DataFrame:
    """The parts of old and new tasks, at the grain of ``task_parts``; an application may have tasks in both."""
    return combined(parts.unionByName(more), KEYS)


def _corr(x: str, y: str) -> str:
    return f"coalesce(try_divide(co_{x}_{y}, sqrt(m2_{x}) * sqrt(m2_{y})), 0D)"


#: The aggregates of ``metrics.AGGREGATES`` over parts that were put together.
AGGREGATES: dict[str, dict[str, str]] = {
    "task": {"total_tasks": "valid_n", "mean_task_duration": "coalesce(try_divide(CAST(valid_sum AS DOUBLE), valid_n), 0D)",
             "std_task_duration": "IF(valid_n > 1, sqrt(m2_valid / (valid_n - 1)), 0D)", "min_task_duration": "valid_min", "max_task_duration": "valid_max"},
    "cpu": {"cpu_time": "cpu_time", "total_run_time_ms": "sum_run_ms", "total_deserialize_time_ms": "sum_deser_ms"},
    "heap": {"avg_heap": "CAST(coalesce(try_divide(CAST(sum_heap_bytes AS DOUBLE), n), 0) AS BIGINT)", "max_heap": "max_heap",
             "avg_offheap": "CAST(coalesce(try_divide(CAST(sum_offheap_bytes AS DOUBLE), n), 0) AS BIGINT)", "max_offheap": "max_offheap",
             "total_heap": "sum_heap_bytes", "total_offheap": "sum_offheap_bytes"},
    "gc": {"total_gc_time_ms": "sum_gc_ms", "minor_gc_time_ms": "sum_minor_gc_ms", "major_gc_time_ms": "sum_major_gc_ms", "total_run_time_ms": "sum_run_ms"},
    "spill": {"memory_bytes_spilled": "sum_mem_spill_bytes", "disk_bytes_spilled": "sum_disk_spill_bytes", "input_bytes": "sum_in_bytes", "tasks_with_spill": "pos_mem_spill_bytes"},
    "shuffle": {"shuffle_read_bytes": "sum_sh_read_bytes", "shuffle_write_bytes": "sum_sh_write_bytes", "shuffle_time_ms": "sum_fetch_wait_ms", "total_run_time_ms": "sum_run_ms",
                "shuffle_write_time_ms": "sum_sh_write_time", "shuffle_records_written": "sum_sh_write_records", "tasks_with_shuffle_read": "pos_sh_read_bytes",
                "tasks_with_shuffle_write": "pos_sh_write_bytes"},
    "io": {"input_bytes": "sum_in_bytes", "output_bytes": "sum_out_bytes", "input_records": "sum_in_records", "output_records": "sum_out_records",
           "tasks_with_input": "pos_in_bytes", "tasks_with_output": "pos_out_bytes"},
    "corr": {"gc_vs_duration": _corr("gc_ms", "duration_ms"), "spill_vs_gc": _corr("mem_spill_bytes", "gc_ms"), "shuffle_vs_duration": _corr("fetch_wait_ms", "duration_ms")},
}
#: The sums of ``stages.STAGE_SUMS`` over parts put together by stage.
STAGE_SUMS = {
    "total_tasks": "n", "total_duration_ms": "valid_sum", "mean_task_duration_ms": "coalesce(try_divide(CAST(valid_sum AS DOUBLE), valid_n), 0D)",
    "max_task_duration_ms": "coalesce(valid_max, 0)", "min_task_duration_ms": "coalesce(valid_min, 0)", "total_gc_time_ms": "sum_gc_ms",
    "total_memory_spilled": "sum_mem_spill_bytes", "total_shuffle_read": "sum_sh_read_bytes", "total_input": "sum_in_bytes",
}
