"""op11_whitening, op12_centroids and op13_pieces against brute force and the sentencepiece library, and on odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import centroids, pieces, whitening
from eventlens.llm.queries import PIECE_MODEL

SF = "/root/testdata/sf0.001"
sentencepiece = pytest.importorskip("sentencepiece")
PATH = pytest.importorskip("public_tokenizers").path(PIECE_MODEL)
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


ODD = ["", " ", "  ", " " * 17, " " * 33, "x" + " " * 100 + "y", " " * 5000 + "the", "▁", "▁▁x ▁", "\n\n\t x", " \n ", "a" * 1000, "x" * 30_000, "ab" * 500, "é漢字가😀" * 50, "\x00\x01", "﻿",
       "</s><s><0x0A><unk>", "long word " * 30_000, "漢字" * 40_000, None]


def test_pieces_equal_the_library(spark, library):
    rng = random.Random(1)
    words = [s.replace("▁", " ") for s in pieces.codec(PATH).file.ids]
    texts = ODD + ["".join(rng.choice(rng.choice(["ab ", "etaoin shrdlu", "  \n\tabc", "012 .,;", "漢字仮名 aé", "aeiou▁ "])) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "ids_sha256": F.lit(1)})
    docs = docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = sorted(map(tuple, pieces.digests(docs, PATH).select("n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert got == sorted(expected(library, r.text) for r in docs.collect())


def test_ids_and_texts_of_pieces(spark, library):
    docs = spark.createDataFrame([(1, "Hello  world \n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.token_ids(docs, PATH).collect()}
    assert got[1].ids == library.encode("Hello  world \n", add_eos=True) and got[1].decoded == "Hello  world \n" and got[2].ids == [2] and got[2].decoded == ""


def test_any_ids_decode_as_the_library_does(library):
    rng = random.Random(2)
    codec = pieces.codec(PATH)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32_000)]) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids)


def test_rounds_merge_as_one_merge_at_a_time_does():
    """Random merge lists, with merges that outrank the one before and with equal ranks."""
    rng = random.Random(3)
    for _ in range(300):
        strings = ["a", "b", "c"]
        for _ in range(rng.randrange(1, 12)):
            strings.append(rng.choice(strings) + rng.choice(strings))
        strings = list(dict.fromkeys(strings))
        score = {s: -float(rng.randrange(6)) for s in strings}
        file = pieces.PieceFile.__new__(pieces.PieceFile)
        file.ids, file.size = {s: i for i, s in enumerate(strings)}, len(strings)
        file._pairs(score)
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(10)]
        symbols = np.array([file.ids[c] for w in words for c in w])
        owner = np.repeat(np.arange(10), [len(w) for w in words])
        out, of = pieces.merge_rounds(file, symbols, owner)
        for k, word in enumerate(words):
            now = list(word)
            while True:
                best = min(((-score[x + y], i) for i, (x, y) in enumerate(zip(now, now[1:])) if x + y in score), default=None)
                if best is None:
                    break
                now[best[1]:best[1] + 2] = [now[best[1]] + now[best[1] + 1]]
            assert [strings[i] for i in out[of == k]] == now, (score, word)


VECTORS = [(900, None), (901, [0.5, None, 1.0, 2.0]), (902, [NAN, 0.0, 0.0, 0.0]), (903, [INF, 0.0, 0.0, 0.0]), (904, []), (None, [0.25, 0.5, -0.25, 0.125])]


def whitening_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(k, rows[0][1]) for k in range(1000, 1200)] + [rows[5], rows[5]]
    rows += VECTORS + [(2000 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(9, 2)))] + [(3000, [7.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "x": F.lit(1), "component": F.lit(2)})


def test_whitening_equals_brute_force(spark):
    rows, table = whitening_rows(spark)
    got = whitening.whitened(table).collect()
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c + 1) for i, x in kept for c in range(min(4, len(x))))
    for size in (4, 2):
        fit = sorted({x for _, x in kept if len(x) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array(fit, float) - np.array(sums) / n
        e, q = np.linalg.eigh(centred.T @ centred / n)
        e, q = e[::-1], q[:, ::-1]
        by = {}
        for r in got:
            by.setdefault(r.vec_id, {}).setdefault(r.component, r)
        errors = set()
        for i, x in kept:
            if len(x) != size:
                continue
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for c in range(size):
                r = by[i][c + 1]
                white = (np.array(x) - np.array(sums) / n) @ q[:, c] / np.sqrt(e[c])
                assert r.n == n and r.deviation == deviation and r.deviation_digits == str(deviation)
                assert abs(r.whitened) == pytest.approx(abs(white), rel=1e-8, abs=1e-8) and r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
                errors.add(r.identity_error)
        assert len(errors) == 1 and errors.pop() < 1e-9
    single = [r for r in got if r.vec_id == 3000]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(1, 0, None, 0.0, 0.0)]


def test_scatter_is_exact_for_every_width():
    rng = np.random.default_rng(0)
    for low, high, n, d in ((-130, 130, 300, 5), (-2**62, 2**62, 70, 3), (0, 1, 10, 2), (-2**63, 2**63 - 1, 130, 3), (5, 6, 64, 4)):
        x = rng.integers(low, high, (n, d), dtype=np.int64)
        sums, cross = whitening.scatter(x)
        wide = x.astype(object)
        gram = wide.T.dot(wide)
        assert sums == [int(v) for v in wide.sum(axis=0)] and all(cross[i][k] == gram[i, i + k] for i in range(d) for k in range(d - i))
    for n, sums, x in ((1000, [3, -5], [[1, 2], [3, -4]]), (10**9, [2**50, -2**55], [[2**40, 1], [-2**63, 5]])):
        assert whitening.deviations(np.array(x), n, sums) == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]


def test_large_deviations_leave_the_range_of_long(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e300, 2.0])], "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = {1: (256 * 10**15, 0), 2: (-256 * 10**15, 256), 3: (2**63 - 1, 512)}
    sums = [sum(c) for c in zip(*x.values())]
    for r in got:
        assert r.deviation is None and r.deviation_digits == str(sum((3 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)))


def k_means(rows, k=8, rounds=10):
    """Exact, with Python integers."""
    at = [list(v) for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in rows]
        at = [[sum(col) // len(col) for col in zip(*[v for (_, v), w in zip(rows, where) if w == n])] if n in where else c for n, c in enumerate(at)]
    return at, [nearest(v) for _, v in rows]


@pytest.mark.parametrize("scale", [1.0, 0.002, 1e9])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(5, 64))[rng.integers(0, 5, 150)] * 0.2 + rng.normal(size=(150, 64)) * 0.1) * scale
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(k, v[0].tolist()) for k in range(500, 530)] + [(3, v[3].tolist())]
    odd = [(900, None), (901, [0.0] * 63), (902, [0.0] * 63 + [NAN]), (903, [None] + [0.0] * 63), (904, [INF] * 64), (905, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "x": F.lit(0)})
    got = sorted(centroids.clustered(table).collect(), key=lambda r: (r.vec_id, r.cluster))
    whole = [(i, tuple(math.floor(1024 * c) for c in x)) for i, x in rows]
    at, found = k_means(whole)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    inertia = [sum(d for d, w in found if w == n) for n in range(8)]

    def fits(x):
        return x if x < 1 << 63 else None
    lost = any(d >= 1 << 63 for d, _ in found)
    want = sorted(((i, n, fits(d), shas[n]) for (i, _), (d, n) in zip(whole, found)), key=lambda r: r[:2])
    assert [(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got] == want
    if not lost:
        assert all((r.cluster_inertia, r.inertia) == (fits(inertia[r.cluster]), fits(sum(inertia))) for r in got)
    assert all(1 <= r.n_distances <= 8 for r in got)


def test_walk_stops_early_and_keeps_ties():
    lists = centroids.Lists([[0, 0], [10, 10], [500, 500], [10, 10], [-300, 4]])
    which, far, met = lists.nearest(np.array([[10, 10], [5, 5], [490, 510], [0, 0]]))
    assert which.tolist() == [1, 0, 2, 0] and far.tolist() == [0, 50, 200, 0] and met.tolist()[2] < 5


def test_fewer_vectors_than_centroids_and_rows_without_an_id(spark):
    table = spark.createDataFrame([(None, [float(k)] * 64) for k in range(2)] + [(7, [3.0] * 64)], "vec_id long, embedding array<double>")
    got = centroids.clustered(table).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {0} and next(r.cluster for r in got if r.vec_id == 7) == 0


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for made in (whitening.whitened(vectors), centroids.clustered(vectors), pieces.digests(spark.createDataFrame([], "doc_id long, text string"), PATH)):
        assert made.count() == 0
    assert whitening.whitened(spark.createDataFrame(VECTORS[:5], "vec_id long, embedding array<double>")).count() == 0
