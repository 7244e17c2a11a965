"""Near-duplicate embeddings through an inverted multi-index.

Vectors are cut into halves, each half has a codebook of its own, and the pairs of codewords form a grid of cells. From
a vector, a multi-sequence traversal visits the cells in the order of a lower bound on the distance to anything inside
them and stops when the bound passes the wanted radius, so that every partner is met (recall 1) and the rest of the
grid is not looked at. Each meeting of a vector and a cell is verified with exact cosines.

A pair is met once: within its common cell, or where the vector with the lower cell visits the higher one. Cells are cut
into blocks of bounded size; a task compares two blocks and sends on one count for each vector and a spanning forest
of the links it found, never the pairs.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import components
from eventlens.plans.stash import stash

#: Vectors used to train the codebooks, at most about so many; vectors wanted in a cell; vectors of a block.
SAMPLE, CELL, BLOCK = 8_192, 400, 800


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres, started with points spread over the sample."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return np.unique(centres, axis=0)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points ** 2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(axis=1), 0)


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, and the squared distance at which the region of each centre begins (to its bisecting plane)."""
    d = distances(points, centres)
    near = d.argmin(axis=1)
    gap = np.sqrt(distances(centres, centres))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(gap > 0, (d - d[np.arange(len(points)), near][:, None]) / (2 * gap), 0.0)
    return near, np.maximum(h, 0) ** 2


def visited(first: np.ndarray, second: np.ndarray, radius2: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells by ascending sum of both bounds, as far as the radius."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heappop(heap)
        if bound > radius2:
            break
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _units(column) -> np.ndarray:
    v = np.array(column.to_pylist(), np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components would leave the range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linked(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links join vectors of one label whose cosine is ``least`` or more.

    Vectors that are null, zero or hold null or non-finite components, or have no label, link with nothing; so do rows
    without an id. Vectors of different lengths are never linked. Equal vectors are one class whose members all link
    with each other; a row repeated with the same id counts once and is returned as often as it comes. An id may come with
    several vectors: each row gets the links and the component of its own. An empty table gives an empty one; extra columns
    are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    valid = rows.where(F.coalesce(good, F.lit(False))).withColumn("g", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")))
    classes = stash(valid.groupBy("g", "v", "vec_id").agg(F.lit(1).alias("one")).groupBy("g", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
                    .select("g", "v", F.monotonically_increasing_id().alias("rep"), "least", "copies"))  # a class is named by a number given once, where it is stored
    total, groups = classes.agg(F.count("*"), F.approx_count_distinct("g")).first()
    k = int(min(256, max(1, (total / max(groups, 1) / CELL) ** 0.5)))
    draw = classes if total <= SAMPLE else classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / total))
    by_size: dict[int, list] = {}
    for r in draw.select("rep", "v").orderBy("rep").collect():  # a bounded sample
        by_size.setdefault(len(r.v), []).append(r.v)
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, sample in by_size.items():
        u = np.array(sample, np.float64)
        u /= np.abs(u).max(axis=1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        books[size] = tuple(codebook(part, min(k, len(u))) if part.shape[1] else np.zeros((1, 0)) for part in (u[:, :size // 2], u[:, size // 2:]))
    radius2 = 2 * (1 - least) + 1e-9

    def place(batches):
        for b in batches:
            at, cells, homes = [], [], []
            sizes = np.array([len(x) for x in b.column("v")])
            for size in np.unique(sizes):
                rows_here = np.flatnonzero(sizes == size)
                u = _units(b.column("v").take(pa.array(rows_here)))
                one, two = books.get(int(size), (np.zeros((1, size // 2)), np.zeros((1, size - size // 2))))
                (n1, h1), (n2, h2) = bounds(u[:, :size // 2], one), bounds(u[:, size // 2:], two)
                for k, row in enumerate(rows_here):
                    home = int(n1[k]) * len(two) + int(n2[k])
                    at.append(row)
                    cells.append(home)
                    homes.append(True)
                    for i, j in visited(h1[k], h2[k], radius2):
                        if i * len(two) + j > home:
                            at.append(row)
                            cells.append(i * len(two) + j)
                            homes.append(False)
            for s in range(0, len(at), 20_000):
                part = b.take(pa.array(at[s:s + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[s:s + 20_000], pa.int64()), pa.array(homes[s:s + 20_000], pa.bool_())], [*part.schema.names, "cell", "home"])

    placed = classes.select("g", "v", "rep", "copies").mapInArrow(place, "g string, v array<double>, rep long, copies long, cell long, home boolean")
    sizes = placed.groupBy("g", "cell").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_visit"))
    parts = stash(sizes.where("n_home > 0 AND n_home + n_visit > 1").select("g", "cell", F.ceil(F.col("n_home") / BLOCK).cast("int").alias("nh"), F.ceil(F.col("n_visit") / BLOCK).cast("int").alias("nv")))
    own = F.expr("pmod(xxhash64(rep), if(home, nh, nv))").cast("int")
    among = "transform(sequence(0, nh - 1), o -> struct(false AS visit, least(own, o) AS i, greatest(own, o) AS j))"
    meets = "if(nv > 0, transform(sequence(0, nv - 1), o -> struct(true AS visit, own AS i, o AS j)), array())"
    dealt = (placed.join(parts, ["g", "cell"]).withColumn("own", own)
             .withColumn("t", F.explode(F.expr(f"if(home, concat({among}, {meets}), transform(sequence(0, nh - 1), o -> struct(true AS visit, o AS i, own AS j)))")))
             .select("g", "cell", "t.visit", "t.i", "t.j", "home", "own", "rep", "copies", "v"))

    def compare(key, t):
        visit, i, j = (x.as_py() for x in key[2:])
        home, own_part = t.column("home").to_numpy(), t.column("own").to_numpy()
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        u = _units(t.column("v"))
        left = np.flatnonzero(home & (own_part == i))
        right = np.flatnonzero(~home) if visit else np.flatnonzero(home & (own_part == j))
        close = u[left] @ u[right].T >= least
        same = not visit and i == j
        if same:
            np.fill_diagonal(close, False)
        degree = np.zeros(len(rep), np.int64)
        degree[left] += close @ copies[right]
        if not same:
            degree[right] += close.T @ copies[left]
        low = rep.copy()
        while True:
            before = low.copy()
            big = np.iinfo(np.int64).max
            if len(left) and len(right):
                low[right] = np.minimum(low[right], np.where(close, low[left][:, None], big).min(axis=0))
                low[left] = np.minimum(low[left], np.where(close, low[right][None, :], big).min(axis=1))
            if (low == before).all():
                break
        some = np.flatnonzero(degree)
        return pa.table([pa.array(rep[some]), pa.array(low[some]), pa.array(degree[some])], names=["a", "b", "n"])

    found = stash(dealt.groupBy("g", "cell", "visit", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    degrees = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comp = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    rooted = classes.join(degrees, "rep", "left").join(comp, "rep", "left").select("g", "v", "least", F.expr("copies - 1 + coalesce(n, 0)").alias("n_links"), F.coalesce("component", "rep").alias("root"))
    solved = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("g", "v", "n_links", "component")
    inside = valid.join(solved, ["g", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    outside = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
