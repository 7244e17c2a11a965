"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of hashed character n-grams. Those whose presence depends on the label (chi-squared)
are scaled by the log ratio of their smoothed counts in toxic and other labelled texts, and a logistic regression is
fitted on the scaled features. N-grams are made and counted where the texts lie; the driver sees the chosen slots and,
for a bounded sample of labelled rows, which of them each row has.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eventlens.llm.common import remainder, whole_rows
from eventlens.plans.stash import stash

BITS, ORDERS = 20, (5, 7)
#: Labelled rows used in training, at most about so many (all when there are fewer).
TRAIN_ROWS = 6_000
THRESHOLD, MIN_ROWS, CHI = 0.7, 3, 20.0
_GAP = re.compile(r"[\W\d_]+")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gram_slots(text: str) -> np.ndarray:
    """Slots of all n-grams of the lower-cased letters, words parted by one space; with repeats."""
    text = " " + _GAP.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    h = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[:len(points) - n + 1] * np.uint64(_MULTIPLIERS[0]) + points[n - 1:] + np.uint64(1)
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIERS[1]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def _places(slots: bytes) -> np.ndarray:
    chosen = np.frombuffer(slots, np.int32)
    places = np.full(1 << BITS, -1, np.int32)
    places[chosen] = np.arange(len(chosen))
    return places


def chosen_features(text: str, slots: bytes) -> np.ndarray:
    """Places, among the chosen slots, of those that the text has."""
    found = _places(slots)[gram_slots(text)]
    return np.unique(found[found >= 0])


def fit(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, rounds: int = 60, rate: float = 0.3, strength: float = 0.01) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic regression. A constant score when only one label is there."""
    labels = np.array([y for _, y in rows], np.float64)
    w = np.zeros(len(ratio))
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(rows) + 1) if len(rows) else 0.0
        return w, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    flat = np.concatenate([x for x, _ in rows]).astype(np.int64)
    scaled = ratio[flat]
    scaled = scaled / damping(np.bincount(owner, weights=scaled ** 2, minlength=len(rows)))[owner]
    b = float(np.log(labels.mean() / (1 - labels.mean())))
    w_sum, b_sum = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(rounds):  # full gradient, a step of its own for each weight
        z = np.bincount(owner, weights=w[flat] * scaled, minlength=len(rows)) + b
        d = 1 / (1 + np.exp(-z)) - labels
        g = np.bincount(flat, weights=d[owner] * scaled, minlength=len(ratio)) + strength * w
        w_sum += g * g
        b_sum += d.sum() ** 2
        w -= rate * g / np.sqrt(w_sum)
        b -= rate * d.sum() / np.sqrt(b_sum)
    return w, b


def damping(squares: np.ndarray) -> np.ndarray:
    """Square root of a row's scaled length: long texts have more features, but a few telling ones must still count."""
    return np.maximum(squares, 1e-9) ** 0.25


class Model:
    def __init__(self, slots: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.ratio, self.weights, self.bias = slots.astype(np.int32).tobytes(), ratio, weights * ratio, bias

    def score(self, text: str) -> float:
        at = chosen_features(text, self.slots)
        z = self.bias + (self.weights[at].sum() / damping(np.square(self.ratio[at]).sum()) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, smooth: float = 1.0) -> Model:
    """Learn from ``docs`` with a row in ``labels`` (doc_id, toxic 0 or 1), remainder of the id by 3 not 1.

    A label given several times counts once, as toxic if any says so. About ``train_rows`` labelled documents, drawn by
    a hash of the id, are used. Rows with a null id, label or text are not learned from. Without rows, or with one
    label only, scores are constant.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))
    rows = stash(docs.select("doc_id", "text").where("text IS NOT NULL").join(known, "doc_id").select("text", (F.col("y") > 0).cast("int").alias("y")).repartition(8))

    def count(batches):
        both, pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for x, y in zip(b.column(0), b.column(1).to_pylist()):
                at = np.unique(gram_slots(x.as_py()))
                both[at] += 1
                pos[at] += y
        at = np.flatnonzero(both)
        for s in range(0, len(at), 50_000):
            part = at[s:s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(both[part]), pa.array(pos[part])], ["slot", "n_both", "n_pos"])

    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    expected = F.col("n_both") * n_pos / F.lit(max(n, 1))
    spread = expected * (1 - n_pos / max(n, 1)) * (1 - F.col("n_both") / max(n, 1))
    counts = (rows.mapInArrow(count, "slot int, n_both long, n_pos long").groupBy("slot").agg(F.sum("n_both").alias("n_both"), F.sum("n_pos").alias("n_pos"))
              .where(F.col("n_both") >= MIN_ROWS).where((F.col("n_pos") - expected) ** 2 >= CHI * spread))
    table = counts.toPandas().sort_values("slot")  # at most one row per slot of the fixed number of slots
    slots, both, pos = (table[c].to_numpy() for c in ("slot", "n_both", "n_pos"))
    ratio = np.log(((pos + smooth) / (n_pos + 2 * smooth)) / ((both - pos + smooth) / (n - n_pos + 2 * smooth)))
    chosen = slots.astype(np.int32).tobytes()

    def has(batches):
        for b in batches:
            found = [chosen_features(x.as_py(), chosen).tolist() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], ["at", "y"])

    sample = rows.mapInArrow(has, "at array<int>, y int").collect()  # at most about train_rows rows
    weights, bias = fit(sorted(((np.array(r.at, np.int64), r.y) for r in sample), key=lambda r: (r[1], r[0].tolist())), ratio)
    return Model(slots, ratio, weights, bias)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with _toxic (0 to 1), from the whole text alone. Null and empty texts get the score of no feature."""

    def run(batches):
        for b in batches:
            out = [model.score(x.as_py() or "") for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "_toxic"])

    given = docs.select(*keep, F.col(text_col).alias("_text"))
    return given.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in given.schema[:-1]), StructField("_toxic", DoubleType())]))


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; an empty table gives an empty one."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), F.col("_toxic").alias("score"),
                         (F.col("_toxic") >= THRESHOLD).cast("int").alias("predicted"))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored below the threshold. Columns stay as they are, whatever their names."""
    return score(whole_rows(docs), train(docs, labels), ("doc",)).where(F.col("_toxic") < THRESHOLD).select("doc.*")
