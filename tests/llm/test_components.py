"""Connected components against a union-find, and the tasks that they take."""

import random
import uuid

import pytest

from eventlens.llm import common
from eventlens.plans.stash import setting


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


def graph(spark, edges, parts=8):
    random.Random(4).shuffle(edges)
    return spark.createDataFrame(spark.sparkContext.parallelize(edges, parts), "a long, b long")


def chains():
    """A long chain in order, one whose nodes are shuffled, one that goes up and down, a star, loops, null ends, repeated edges, nodes below zero."""
    mixed = random.Random(5).sample(range(10_000, 10_300), 300)
    zigzag = [20_000 + (k // 2 if k % 2 else 1000 + k // 2) for k in range(300)]
    edges = [(k, k + 1) for k in range(300)] + list(zip(mixed, mixed[1:])) + list(zip(zigzag, zigzag[1:])) + [(30_000 + k, 30_000) for k in range(1, 500)]
    return edges + edges[:50] + [(b, a) for a, b in edges[:50]] + [(5, 5), (40_000, 40_000), (None, 3), (3, None), (None, None), (-7, -9), (-(1 << 62), 1 << 62)]


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_components_equal_union_find(spark, monkeypatch, at_once):
    """Also where a task merges hardly any of its edges, so that all is left to the rounds."""
    monkeypatch.setattr(common, "EDGES", at_once)
    found = common.components(graph(spark, chains())).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == brute(chains())
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    found = common.components(graph(spark, edges)).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == brute(edges)


def test_a_round_of_components_has_one_shuffle(spark):
    """Groups of near copies take a few shuffles altogether, so many partitions do not make many small tasks."""
    rng = random.Random(7)
    edges = [(100 * g + k, 100 * g + rng.randrange(k)) for g in range(60) for k in range(1, 100)]
    tag = uuid.uuid4().hex
    spark.sparkContext.addJobTag(tag)
    try:
        with setting(spark, "spark.sql.shuffle.partitions", "64"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            found = common.components(graph(spark, edges)).collect()
    finally:
        spark.sparkContext.removeJobTag(tag)
    assert {r.node: r.component for r in found} == brute(edges)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)
    assert tasks <= 8 * 64, tasks
