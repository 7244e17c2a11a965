"""Helpers of the corpus operators: columns that may be missing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

#: Edges that a task merges at once.
EDGES = 1 << 20


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc, text): every row as a struct beside its text, so that no working column clashes with a column of the table."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))


def remainder(name: str, n: int) -> Column:
    """crc32 of a value's decimal text modulo ``n``; null stays null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) of the edges given; a smallest node itself is left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while len(i):
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))
        while (low[low] != low).any():
            low = low[low]
        i, j = low[i], low[j]
        i, j = i[i != j], j[i != j]
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars: one link for each node, or for each ``EDGES`` edges that it is in."""
    waiting: list[pa.RecordBatch] = []

    def merge():
        a, b = _stars(*(np.concatenate([x.column(k).to_numpy() for x in waiting]) for k in (0, 1)))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= EDGES:
            yield merge()
    if waiting:
        yield merge()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of undirected edges (a, b): rows (node, component).

    Tasks reduce the edges they hold to stars. Then a link of a node moves on: to the smallest node beside its end, or, if
    the node has a smaller link, from the node to that one's end; until each node has one link, to a node that has none.
    Every move takes a link to smaller nodes and none is added, so this ends, and what is left of a chain is halved by each
    round. A round has one shuffle, that of the nodes, whose minima are combined before it; links stay where they lie, as
    nodes that are not done are stored and broadcast once they are few (until then adaptive execution can split a hot
    one). Rounds are written to the shared folder, which cuts the lineage and survives lost executors. Nodes without edges are not
    returned. Null ends and loops are ignored; repeated edges count once; an empty table gives an empty one.
    """
    ends = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"), (F.col("a") != F.col("b")).alias("apart"))
    links = stash(ends.where("apart").select("a", "b").mapInArrow(_merged, "a long, b long"))
    while True:
        sides = links.select(F.explode(F.expr("array(struct(a AS node, b AS low, b AS high, false AS end), struct(b AS node, null AS low, null AS high, true AS end))")).alias("s"))
        nodes = sides.select("s.*").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("end").alias("end"))
        undone = stash(nodes.where("low < high OR (low IS NOT NULL AND end)").select("node", "low"))
        if undone.isEmpty():
            return nodes.select("node", F.coalesce("low", "node").alias("component"))
        beside = links.join(undone.selectExpr("node AS a", "low AS low_a"), "a", "left").join(undone.selectExpr("node AS b", "low AS low_b"), "b", "left")
        moved = beside.select(F.expr("if(low_a < b, struct(b AS a, low_a AS b), struct(a, coalesce(low_b, b) AS b))").alias("m")).select("m.*")
        links = stash(moved.mapInArrow(_merged, "a long, b long"))
