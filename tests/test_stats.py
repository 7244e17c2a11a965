import numpy as np
import pytest

from eventlens.functions.graph import lifts
from eventlens.functions.stats import grouped_quantiles, merged_sketches, rank_error, rank_sketches, sketch_quantiles, value_counts
from eventlens.operators.causes import counted_between
from eventlens.operators.stages import ancestors_of, stage_edges, stage_lineage

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"one": [5], "two": [0, 9], "same": [7] * 50, "skew": (rng.pareto(1.0, 3000) * 1000).astype(int).tolist(),
              "big": rng.integers(2**40, 2**41, 500).tolist(), "zero": [0] * 10 + [1, 2, 3]}
    df = spark.createDataFrame([(g, int(x)) for g, xs in groups.items() for x in xs], "g STRING, x BIGINT")
    got = {r.g: r for r in grouped_quantiles(value_counts(df, ["g"], "x"), ["g"], PROBS).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert [got[g][n] for n in PROBS] == pytest.approx([float(np.quantile(xs, p)) for p in PROBS.values()], rel=1e-12)


def test_quantiles_of_doubles_of_any_size_and_sign(spark):
    rng = np.random.default_rng(3)
    groups = {"ratio": rng.random(400), "signed": rng.normal(size=401), "sizes": 2.0 ** rng.integers(-1000, 1000, 300), "close": 1e15 + np.arange(500), "powers": 2.0 ** np.arange(-30, 30),
              "odd": np.array([0.0, -0.0, 5e-324, -5e-324, 1.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("ratio", float("nan")), ("ratio", None), ("ratio", float("inf"))], "g STRING, x DOUBLE")
    got = {r.g: r for r in grouped_quantiles(value_counts(df, ["g"], "x"), ["g"], PROBS).collect()}
    for g, xs in groups.items():
        assert [got[g][n] for n in PROBS] == pytest.approx([float(np.quantile(xs, p)) for p in PROBS.values()], rel=1e-12), g


def test_merged_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(4)
    x = rng.pareto(1.2, 60_000)
    df = spark.createDataFrame([("a", k % 7, float(v)) for k, v in enumerate(x)], "g STRING, part INT, x DOUBLE")
    one = merged_sketches(rank_sketches(df, ["g", "part"], "x"), ["g"])
    got = sketch_quantiles(one, ["g"], PROBS).first()
    assert got.total == len(x)
    for n, p in PROBS.items():
        assert abs((x <= got[n]).mean() - p) <= rank_error() + 1 / len(x)


STAGE_ROW = ("app_id STRING, stage_id BIGINT, attempt BIGINT, name STRING, num_tasks BIGINT, parent_ids ARRAY<BIGINT>, rdd_names ARRAY<STRING>, submission_ms BIGINT, "
             "completion_ms BIGINT, failure_reason STRING, is_submitted BOOLEAN, is_completed BOOLEAN")


def stage_rows(spark, parents):
    return spark.createDataFrame([(app, i, 0, "s", 1, p, [], 1, 2, None, True, True) for app, rows in parents.items() for i, p in rows.items()], STAGE_ROW)


def test_lineage_of_a_diamond(spark):
    st = stage_rows(spark, {"a": {0: [], 1: [0], 2: [0], 3: [1, 2], 4: [3, 0]}, "up": {0: [2], 1: [], 2: [1]}, "none": {5: []}})
    depth = {(r.app_id, r.stage_id): (r.depth, r.cyclic) for r in stage_lineage(st).collect()}
    assert depth == {("a", 1): (1, False), ("a", 2): (1, False), ("a", 3): (2, False), ("a", 4): (3, False), ("up", 0): (2, False), ("up", 2): (1, False)}
    assert stage_lineage(st.where("app_id = 'none'")).count() == 0


def test_cycles_are_marked_and_end(spark):
    st = stage_rows(spark, {"a": {0: [], 1: [0, 3], 2: [1], 3: [2], 4: [3], 5: [0], 6: [6]}, "b": {k: [k - 1] for k in range(1, 9)}})
    got = {(r.app_id, r.stage_id): (r.depth, r.cyclic) for r in stage_lineage(st).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", k): (None, True) for k in (1, 2, 3, 4, 6)} | {("a", 5): (1, False)}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", k): (k, False) for k in range(1, 9)}
    up = {(r.stage_id, r.ancestor_id): r.hops for r in ancestors_of(st, st.where("app_id = 'a' AND stage_id IN (1, 4, 6)").select("app_id", "stage_id")).collect()}
    assert up == {(1, 0): 1, (1, 3): 1, (1, 2): 2, (1, 1): 3, (4, 3): 1, (4, 2): 2, (4, 1): 3, (4, 0): 4, (6, 6): 1}


def test_ancestors_equal_a_search_and_take_few_rounds(spark):
    rng = np.random.default_rng(5)
    graphs = {"chain": {k: [k - 1] if k else [] for k in range(120)}, "wide": {k: sorted({int(p) for p in rng.integers(0, k, 3)}) if k > 3 else [] for k in range(60)}}
    st = stage_rows(spark, graphs)
    steps, _ = lifts(stage_edges(st), "app_id", "stage_id", "parent_id")
    assert len(steps) == 7  # walks of 1 to 64 edges on a chain of 119
    for bound in (None, 3):
        got = {(r.app_id, r.stage_id, r.ancestor_id): r.hops for r in ancestors_of(st, st.where("stage_id IN (59, 119)").select("app_id", "stage_id"), bound).collect()}
        want = {}
        for app, parents in graphs.items():
            for s in {59, 119} & set(parents):
                near, hops = {s}, 0
                while near and hops != bound:
                    near, hops = {p for x in near for p in parents[x]} - {a for (g, t, a) in want if (g, t) == (app, s)}, hops + 1
                    want |= {(app, s, p): hops for p in near}
        assert got == want


def test_counts_between_equal_pairs(spark):
    rng = np.random.default_rng(6)
    events = [("a", int(t)) for t in rng.integers(-5000, 5000, 400)] + [("b", 7)] * 50 + [("a", None)]
    spans = [("a", int(t) - w, int(t) + w, k) for k, (t, w) in enumerate(zip(rng.integers(-6000, 6000, 60).tolist(), rng.choice([0, 1, 100, 9000], 60).tolist()))] + [
        ("b", 7, 7, 100), ("b", 8, 6, 101), ("b", None, 9, 102), ("c", 0, 9, 103), ("b", 7, 7, 104)]
    got = counted_between(spark.createDataFrame(events, "app_id STRING, ts_ms BIGINT"), spark.createDataFrame(spans, "app_id STRING, lo BIGINT, hi BIGINT, k INT"), bucket_ms=64).collect()
    want = {k: sum(x == app and t is not None and lo <= t <= hi for x, t in events) if lo is not None else 0 for app, lo, hi, k in spans}
    assert {r.k: r.n for r in got} == want and len(got) == len(spans)


def test_rule_rows_can_be_added(spark):
    from eventlens.operators.rules import rules_eval, rules_table

    rule = (("Many tasks", "none", 0.1, (("total_tasks", ">=", 10.0), ("p99", "<", 5.0))),)
    long = spark.createDataFrame([("a", "total_tasks", 10.0), ("a", "p99", 4.0), ("b", "total_tasks", 10.0), ("b", "p99", 6.0)], "app_id STRING, metric STRING, value DOUBLE")
    got = {r.app_id: (r.matched, r.fires) for r in rules_eval(long, rules_table(spark, rule)).collect()}
    assert got == {"a": (2, True), "b": (1, False)}
