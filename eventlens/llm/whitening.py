"""Whitening of embeddings with exact scatter matrices from bit slices.

Entries are fixed-point integers. In a block of distinct vectors each dimension is shifted by its minimum, and every bit
plane of the shifted values is packed across the rows into 64-bit words. The population count of two ANDed planes, weighted
by the powers of both, adds up to the exact cross-product of two dimensions; the shift is taken out again in integers. Blocks
add up in Spark. The covariance is centred while still an integer, n * sum(x x') - S S', and only then becomes floating point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

#: Rows packed together: 128 words for each plane.
BLOCK = 8_192
#: Exact sums travel in limbs of so many bits, each within a decimal of 38 digits however many blocks there are.
LIMB = 60


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of ``x`` (rows, dimensions), shifted by each dimension's minimum.

    Returns (minima, words (planes, words), dimension of each plane, bit of each plane); a plane that is empty is left out.
    """
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64: right for every range of int64
    shifted = np.concatenate([shifted, np.zeros((-len(x) % 64, x.shape[1]), np.uint64)])
    words, of, bit = [], [], []
    for b in range(int(shifted.max()).bit_length()):
        on = (shifted >> np.uint64(b)) & np.uint64(1)
        some = np.flatnonzero(on.any(axis=0))
        words.append(np.packbits(on[:, some].T.astype(np.uint8), axis=1).view(np.uint64))
        of.append(some)
        bit.append(np.full(len(some), b))
    if not words:
        return low, np.zeros((0, len(shifted) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(np.concatenate(of), kind="stable")
    return low, np.concatenate(words)[order], np.concatenate(of)[order], np.concatenate(bit)[order]


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products (upper triangle: row i from dimension i on) of the rows of ``x``, as Python integers."""
    n, d = x.shape
    low, words, of, bit = planes(x)
    weight = [1 << int(b) for b in bit]
    sums = [0] * d
    cross = [[0] * (d - i) for i in range(d)]
    narrow = (len(bit) == 0 or 2 * int(bit.max()) + n.bit_length() < 62)
    first = np.searchsorted(of, np.arange(d + 1))
    counts = np.bitwise_count(words).sum(axis=1, dtype=np.int64).tolist()
    for p, c in enumerate(counts):
        sums[of[p]] += c * weight[p]
    for i in range(d):
        at = int(first[i])
        total = np.zeros(d - i, np.int64 if narrow else object)
        for p in range(at, int(first[i + 1])):  # every plane of dimension i with every plane from dimension i on
            both = np.bitwise_count(words[p] & words[at:]).sum(axis=1, dtype=np.int64)
            if not len(both):
                continue
            both = both << (bit[at:] + bit[p]) if narrow else np.array([int(c) * weight[p] * weight[q] for c, q in zip(both, range(at, len(words)))], object)
            np.add.at(total, of[at:] - i, both)
        cross[i] = [int(v) for v in total]
    m = [int(v) for v in low]
    for i in range(d):  # sum (a + m)(b + k) = sum ab + m sum b + k sum a + n m k
        cross[i] = [c + m[i] * sums[i + k] + m[i + k] * sums[i] + n * m[i] * m[i + k] for k, c in enumerate(cross[i])]
    return [s + n * k for s, k in zip(sums, m)], cross


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * entry) of vectors with entries, none null or non-finite; out of range of long: its end."""
    good = F.expr("embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    x = F.expr(f"transform(embedding, c -> floor({scale} * cast(c AS double)) + 0L)")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(good).select("vec_id", x.alias("x")).where("size(x) > 0")


def _matrix(column) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """length -> (n, S, cross-products) of distinct vectors; the driver sees d * d / 2 numbers for each length d."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        total: dict[int, list] = {}

        def add(size: int, x: np.ndarray) -> None:
            sums, cross = scatter(x)
            have = total.setdefault(size, [0, [0] * size, [[0] * (size - i) for i in range(size)]])
            have[0] += len(x)
            have[1] = [a + b for a, b in zip(have[1], sums)]
            have[2] = [[a + b for a, b in zip(r, s)] for r, s in zip(have[2], cross)]

        for b in batches:
            for size, part in by_length(b):
                held.setdefault(size, []).append(_matrix(part.column("x")))
                if sum(map(len, held[size])) >= BLOCK:
                    x = np.concatenate(held.pop(size))
                    while len(x) >= BLOCK:
                        add(size, x[:BLOCK])
                        x = x[BLOCK:]
                    held[size] = [x]
        for size, parts in held.items():
            x = np.concatenate(parts)
            if len(x):
                add(size, x)
        for size, (n, sums, cross) in total.items():
            rows = [(-1, -1, n)] + [(-1, i, s) for i, s in enumerate(sums)] + [(i, i + k, c) for i, r in enumerate(cross) for k, c in enumerate(r)]
            i, j, v = zip(*rows)
            low = [c & ((1 << LIMB) - 1) for c in v]
            mid = [(c >> LIMB) & ((1 << LIMB) - 1) for c in v]
            high = [c >> 2 * LIMB for c in v]
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(v), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              *(pa.array(x, pa.int64()) for x in (low, mid, high))], ["size", "i", "j", "low", "mid", "high"])

    limbs = distinct.mapInArrow(run, "size int, i int, j int, low long, mid long, high long")
    total = limbs.groupBy("size", "i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "mid", "high")))
    out: dict[int, tuple[int, list[int], list[list[int]]]] = {}
    counts: dict[int, int] = {}
    for r in total.orderBy("size", "i", "j").collect():
        v = int(r.low) + (int(r.mid) << LIMB) + (int(r.high) << 2 * LIMB)
        if r.j == -1:
            counts[r.size] = v
            out[r.size] = (v, [0] * r.size, [[0] * (r.size - i) for i in range(r.size)])
        elif r.i == -1:
            out[r.size][1][r.j] = v
        else:
            out[r.size][2][r.i][r.j - r.i] = v
    return out


def principal(n: int, sums: list[int], cross: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit components as rows, their eigenvalues, trace) of the covariance, by falling eigenvalue; the largest entry of a component is positive.

    A component without variance (up to rounding) has eigenvalue 0.
    """
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for k, c in enumerate(cross[i]):
            v[i, i + k] = v[i + k, i] = (n * c - sums[i] * sums[i + k]) / (n * n)  # integers up to here; one rounding
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q.T[::-1][:most]
    q = q * np.sign(q[np.arange(len(q)), np.abs(q).argmax(axis=1)])[:, None]
    trace = float(np.trace(v))
    return q, np.where(e > trace * d * np.finfo(float).eps * 8, e, 0.0), trace


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    most = int(np.abs(x).max(initial=0)) if (x > np.iinfo(np.int64).min).all() else 1 << 63
    top = max(map(abs, sums), default=0)
    if max(1, x.shape[1]) * max(most * most, most * top) < 1 << 62 and top < 1 << 62:  # n^2 sum x^2 - 2 n sum x S + sum S^2
        squares, mixed = (x * x).sum(axis=1).tolist(), (x @ np.array(sums, np.int64)).tolist()
        own = sum(s * s for s in sums)
        return [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def whitened(vectors: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits) for every finite vector and component.

    Statistics are over the distinct integer vectors, so a vector that comes very often counts once. Rows whose vector is
    null or holds null or non-finite entries are dropped; an empty vector has no component. Vectors of different lengths are
    fitted apart. A component without variance gets explained 0 and whitened null and is left out of identity_error, which
    is measured on the whitened vectors themselves. deviation is null where it leaves the range of long; deviation_digits
    has all its digits. Repeated rows give repeated rows, null ids stay null, an empty table gives an empty one, and other
    columns are not read.
    """
    rows = integers(vectors, scale)
    distinct = stash(rows.select("x").distinct())
    fits = {}
    for size, (n, sums, cross) in exact_sums(distinct).items():
        q, e, trace = principal(n, sums, cross, most)
        fits[size] = (n, sums, q, e, trace, np.array([s // n for s in sums]), np.array([s % n / n for s in sums]))

    def white(size: int, x: np.ndarray) -> np.ndarray:
        _, _, q, e, _, whole, part = fits[size]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > 0, ((x.astype(float) - whole) - part) @ q.T / np.sqrt(e), np.nan)

    def moments(batches):
        """(size, count, means, co-moments) of the whitened vectors of this task."""
        have: dict[int, list] = {}
        for b in batches:
            for size, part in by_length(b):
                w = np.nan_to_num(white(size, _matrix(part.column("x"))))
                mean = w.mean(axis=0)
                have[size] = merged(have.get(size), (len(w), mean, (w - mean).T @ (w - mean)))
        for size, (count, mean, co) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([count], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                                              pa.array([co.ravel().tolist()], pa.list_(pa.float64()))], ["size", "count", "mean", "co"])

    def together(key, t):
        """A group of tasks' moments as one row."""
        have = None
        for r in t.to_pylist():
            k = len(r["mean"])
            have = merged(have, (r["count"], np.array(r["mean"]), np.array(r["co"]).reshape(k, k)))
        return pa.table([pa.array([t.column("size")[0].as_py()], pa.int32()), pa.array([have[0]], pa.int64()), pa.array([have[1].tolist()], pa.list_(pa.float64())),
                         pa.array([have[2].ravel().tolist()], pa.list_(pa.float64()))], names=["size", "count", "mean", "co"])

    kinds = "size int, count long, mean array<double>, co array<double>"
    parts = distinct.mapInArrow(moments, kinds).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
    error: dict[int, float] = {}
    found: dict[int, tuple] = {}
    for r in parts.groupBy("size", "group").applyInArrow(together, kinds).orderBy("size").collect():  # at most 64 rows for each length
        k = len(r.mean)
        found[r.size] = merged(found.get(r.size), (r["count"], np.array(r.mean), np.array(r.co).reshape(k, k)))
    for size, (count, _, co) in found.items():
        live = fits[size][3] > 0
        off = np.abs(co / count - np.eye(len(live)))[np.ix_(live, live)]
        error[size] = float(off.max()) if off.size else 0.0

    def run(batches):
        for b in batches:
            for size, part in by_length(b):
                n, sums, q, e, trace, *_ = fits[size]
                x = _matrix(part.column("x"))
                w, k = white(size, x), len(e)
                deviation = deviations(x, n, sums)
                fits_long = [v if v < 1 << 63 else None for v in deviation]
                take = pa.array(np.repeat(np.arange(len(x)), k))
                share = e / trace if trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(take), n), pa.int64()),
                    pa.array(fits_long, pa.int64()).take(take), pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(share, len(x)), pa.float64()),
                    pa.array(np.full(len(take), error[size]), pa.float64()), pa.array(map(str, deviation), pa.string()).take(take)],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")


def merged(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and co-moments of two sets together."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)
