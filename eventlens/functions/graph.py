"""Walks in directed graphs by doubling: rounds grow with the logarithm of the length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash


def lifts(edges: DataFrame, group: str, a: str, b: str) -> tuple[list[DataFrame], int]:
    """Pairs joined by a walk of exactly 1, 2, 4, ... edges, and a bound: any longer walk goes around a cycle.

    ``edges`` are rows (group, a, b); nulls are ignored. A group's nodes are spread over tasks by the node in the middle.
    Doubling ends when no such walk is left, or when walks pass the bound, which only cycles allow. On a chain every step has
    one pair for each node; on any graph a step has at most one for each node and ancestor. Every step is stored.
    """
    step = stash(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, a, b).distinct())
    most = step.groupBy(group).agg(F.count_distinct(a).alias("n")).agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while not step.isEmpty():
        out.append(step)
        if 1 << len(out) > 2 * most:
            break
        step = stash(step.withColumnRenamed(b, "_mid").join(step.withColumnRenamed(a, "_mid"), [group, "_mid"]).select(group, a, b).distinct())
    return out, most


def longest_walks(steps: list[DataFrame], most: int, group: str, a: str, b: str) -> DataFrame:
    """(group, a, depth, cyclic): edges of the longest walk from every node that has one; null and true when it never ends.

    From the longest step down: a node keeps a step if some walk of that length goes on from where it stands.
    """
    at = steps[0].select(group, a, F.col(a).alias("_at"), F.lit(0).cast("long").alias("depth")).distinct()
    for k, step in reversed(list(enumerate(steps))):
        further = at.join(step.withColumnRenamed(a, "_at"), [group, "_at"]).select(group, a, F.col(b).alias("_at"), (F.col("depth") + (1 << k)).alias("depth")).distinct()
        best = further.unionByName(at).groupBy(group, a).agg(F.max("depth").alias("depth"))
        at = stash(further.unionByName(at).join(best, [group, a, "depth"], "left_semi"))
    depths = at.groupBy(group, a).agg(F.max("depth").alias("depth"))
    cyclic = F.col("depth") > most
    return depths.select(group, a, F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def reached(steps: list[DataFrame], start: DataFrame, group: str, a: str, b: str, hops: int | None = None) -> DataFrame:
    """(group, a, b, hops): everything reached from the nodes of ``start`` in at least one edge, with the least number of edges.

    Every number of edges is one sum of powers of two, so one join for each power finds all walks; per start and place only the
    shortest goes on.
    """
    at = start.select(group, a).distinct().select(group, a, F.col(a).alias("_at"), F.lit(0).cast("long").alias("hops"))
    for k, step in enumerate(steps):
        more = at.join(step.withColumnRenamed(a, "_at"), [group, "_at"]).select(group, a, F.col(b).alias("_at"), (F.col("hops") + (1 << k)).alias("hops"))
        if hops is not None:
            more = more.where(F.col("hops") <= hops)
        # a start that comes back to itself is kept beside the start
        at = stash(at.unionByName(more).groupBy(group, a, "_at", (F.col("hops") > 0).alias("moved")).agg(F.min("hops").alias("hops")).drop("moved"))
    return at.where("hops > 0").select(group, a, F.col("_at").alias(b), "hops")
