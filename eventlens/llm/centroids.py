"""Exact k-means on integer vectors; each vector finds its centroid by the threshold algorithm.

For every dimension the centroids are sorted by their value. From a vector's own value the lists are walked outward, one
centroid nearer or farther in each dimension a step. A centroid met for the first time gets its exact distance. The squared
gaps at the frontier, summed over the dimensions, bound from below the distance of any centroid not yet met, so a vector stops
when this sum is strictly greater than its best distance: ties have all been met by then. A task walks all its vectors together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

#: Vectors walked together.
BLOCK = 8_192
#: Components below this in size have squared distances within long for up to 64 dimensions and more in Python integers.
NARROW = 1 << 27


class Lists:
    """Per dimension the centroids in the order of their value."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(v) >= NARROW for c in centroids for v in c)
        self.centroids = np.array(centroids, object if wide else np.int64)
        self.order = np.array([sorted(range(len(centroids)), key=lambda c: (centroids[c][d], c)) for d in range(len(centroids[0]))])
        self.values = np.take_along_axis(self.centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
        k, d = self.centroids.shape
        if self.centroids.dtype == object or (len(x) and max(-int(x.min()), int(x.max())) >= NARROW) or d > 256:
            x = x.astype(object)
        n = len(x)
        best = np.full(n, -1, x.dtype)
        which = np.full(n, k)
        met = np.zeros((n, k), bool)
        right = np.empty((n, d), np.int64)  # place of the first list entry at or above the value
        for j in range(d):
            right[:, j] = np.searchsorted(self.values[j], x[:, j])
        left = right - 1
        going, columns = np.arange(n), np.arange(d)
        while len(going):
            lo, hi, v = left[going], right[going], x[going]
            below = v - self.values[columns, np.maximum(lo, 0)]
            above = self.values[columns, np.minimum(hi, k - 1)] - v
            down = (lo >= 0) & ((hi >= k) | (below <= above))  # the nearer side of each list
            gap = np.where(down, below, above)
            met_now = np.zeros((len(going), k), bool)
            met_now[np.arange(len(going))[:, None], self.order[columns, np.where(down, lo, np.minimum(hi, k - 1))]] = True
            left[going] -= down
            right[going] += ~down
            row, c = np.nonzero(met_now & ~met[going])
            met[going] |= met_now
            far = ((v[row] - self.centroids[c]) ** 2).sum(axis=1)
            for number in range(k):
                at = c == number
                rows = going[row[at]]
                better = (best[rows] < 0) | (far[at] < best[rows]) | ((far[at] == best[rows]) & (number < which[rows]))
                best[rows[better]] = far[at][better]
                which[rows[better]] = number
            frontier = (gap ** 2).sum(axis=1)
            going = going[(frontier <= best[going]) & ~met[going].all(axis=1)]
        return which, best, met.sum(axis=1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches):
    for b in batches:
        for s in range(0, b.num_rows, BLOCK):
            part = b.slice(s, BLOCK)
            yield part, _matrix(part.column("x"))


def integers(vectors: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * entry) of vectors with exactly ``size`` finite entries; out of range of long: its end."""
    good = F.expr(f"embedding IS NOT NULL AND size(embedding) = {size} AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    x = F.expr(f"transform(embedding, c -> floor({scale} * cast(c AS double)))")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(good).select("vec_id", x.alias("x"))


def seeds(rows: DataFrame, k: int, salt: str = "3:") -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest SHA-256; equal ids in the order of their vectors, rows without an id last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in rows.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor(sum / count) of the vectors nearest to each, by component; one without vectors stays.

    Every task adds up its vectors; Spark adds the tasks; the driver sees one number for each centroid and dimension.
    """
    lists = Lists(centroids)
    d = len(centroids[0])

    def run(batches):
        total = [[0] * (d + 1) for _ in centroids]
        for _, x in _blocks(batches):
            which, *_ = lists.nearest(x)
            wide = len(x) and max(-int(x.min()), int(x.max())) >= 1 << 48
            for c in np.unique(which):
                part = x[which == c]
                sums = part.astype(object).sum(axis=0) if wide else part.sum(axis=0)
                total[c] = [a + int(b) for a, b in zip(total[c], [*sums, len(part)])]
        rows = [(c, j, v & ((1 << 60) - 1), v >> 60) for c, t in enumerate(total) if t[d] for j, v in enumerate(t)]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["c", "j", "low", "high"])

    sums = (rows.select("x").mapInArrow(run, "c int, j int, low long, high long").groupBy("c", "j")
            .agg(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high")))
    found = {(r.c, r.j): int(r.low) + (int(r.high) << 60) for r in sums.collect()}
    return [[found[c, j] // found[c, d] for j in range(d)] if (c, d) in found else old for c, old in enumerate(centroids)]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances) for every vector of ``size`` finite entries.

    n_distances is the number of exact distances the walk needed for the vector. Other vectors are dropped. With fewer vectors
    than ``k`` there are fewer centroids. Repeated rows count as often as they come; rows without an id take part but are the last to
    start a cluster. Distances and sums that leave the range of long are null. An empty table gives an empty one; other
    columns are not read. The integer vectors are stored once; each round reads them without a shuffle of vectors.
    """
    spark = vectors.sparkSession
    kinds = "vec_id long, cluster int, distance long, n_distances int"
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances"]
    rows = stash(integers(vectors, size, scale))
    centroids = seeds(rows, k)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances int")
    for _ in range(rounds):
        after = moved(rows, centroids)
        if after == centroids:  # all further rounds change nothing
            break
        centroids = after
    lists = Lists(centroids)

    def run(batches):
        for part, x in _blocks(batches):
            which, far, met = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(which, pa.int32()), pa.array([v if v < 1 << 63 else None for v in far.tolist()], pa.int64()),
                                              pa.array(met, pa.int32())], ["vec_id", "cluster", "distance", "n_distances"])

    assigned = stash(rows.mapInArrow(run, kinds))
    wide = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows
    inertia = {r.cluster: None if r.lost else int(r.s) for r in wide}
    total = None if None in inertia.values() else sum(inertia.values())
    small = lambda v: v if v is not None and v < 1 << 63 else None
    table = spark.createDataFrame([(c, small(inertia.get(c, 0)), small(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(names)  # k rows


def oracle_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024) -> str:
    """The same clusters in plain SQL: every distance computed."""
    # the list is read as doubles, whatever its element type
    out = [f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c::DOUBLE))) = {size}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x AS y FROM kept QUALIFY c < {k})"""]
    near = """SELECT vec_id, r, x, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT vec_id, r, x, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
 FROM kept CROSS JOIN c{t}) GROUP BY vec_id, r, x"""
    for t in range(rounds):
        out.append(f"a{t} AS MATERIALIZED ({near.format(t=t)}),\ns{t} AS MATERIALIZED (SELECT c, j, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{t}) GROUP BY c, j),\n"
                   f"m{t} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS y FROM s{t} GROUP BY c),\n"
                   f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN m{t} ON c{t}.c = m{t}.c)")
    out.append(f"z AS MATERIALIZED ({near.format(t=rounds)})")
    return ",\n".join(out) + f"""
SELECT vec_id, z.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(y, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON z.c = c{rounds}.c"""
