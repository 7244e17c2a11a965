"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors, each
rolled (permuted) by its place; a text is the sum (bundle) of its n-gram vectors, and a language the sum of its labelled
texts' unit bundles. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from eventlens.llm.common import remainder, whole_rows

DIMENSIONS, GRAM = 512, 3
#: Labelled rows used for the prototypes, at most about so many (all when there are fewer).
TRAIN_ROWS = 20_000
#: Prototype sums are kept as integers in this unit, so their value does not depend on the order of adding.
UNIT = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter code by code point (0: no letter; case folded), vectors by code, first-touch flags by code.

    Letters beyond the basic plane share the codes of 256 groups. Code 1 is the border of a word.
    """
    code = np.zeros(0x10000, np.int64)
    seen: dict[str, int] = {}
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()[0]
            code[c] = seen.setdefault(low, len(seen) + 2)
    rows = len(seen) + 2 + 256
    return code, np.zeros((rows, DIMENSIONS), np.int8), np.zeros(rows, bool)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of letters, each drawn by a generator seeded with the letter's code."""
    _, table, made = _letters()
    for c in np.unique(codes[~made[codes]]):
        table[c] = np.random.Generator(np.random.PCG64(int(c))).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
        made[c] = True
    return table[codes]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams, as numbers, and their counts. Words have a border on both sides; empty without letters."""
    code, table, _ = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 0x10000
    codes = np.where(low, code[np.where(low, points, 0)], 0)
    if not low.all():
        high = np.array([chr(p).isalpha() for p in points[~low]], bool)
        codes[~low] = np.where(high, len(table) - 256 + points[~low] % 256, 0)
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes[codes == 0] = 1
    codes = codes[(codes != 1) | np.concatenate([[True], codes[:-1] != 1])]
    base = len(table)
    grams = codes[:-2] * base * base + codes[1:-1] * base + codes[2:]
    return np.unique(grams, return_counts=True)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    base = len(_letters()[1])
    first, second, third = grams // (base * base), grams // base % base, grams % base
    return np.roll(letter_vectors(first), 2, axis=1) * np.roll(letter_vectors(second), 1, axis=1) * letter_vectors(third)


def bundles(texts: list[str]) -> np.ndarray:
    """Unit bundle of each text (zero without letters). Texts go through in groups that share their n-gram vectors."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    group, size = [], 0

    def close():
        nonlocal group, size
        if not group:
            return
        grams = np.unique(np.concatenate([g for _, g, _ in group]))
        for s in range(0, len(grams), 8192):
            part = grams[s:s + 8192]
            counts = np.zeros((len(group), len(part)), np.float32)
            for row, (_, g, n) in enumerate(group):
                at = np.searchsorted(part, g)
                here = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == g)
                counts[row, at[here]] = n[here]
            out[[k for k, _, _ in group]] += counts @ gram_vectors(part).astype(np.float32)
        group, size = [], 0

    for k, text in enumerate(texts):
        g, n = gram_counts(text)
        if len(g):
            group.append((k, g, n))
            size += len(g)
        if len(group) >= 64 or size > 60_000:
            close()
    close()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _texts(column, rows: int = 256):
    for s in range(0, len(column), rows):
        yield s, [x.as_py() for x in column[s:s + rows]]


def prototypes(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, list[float]]:
    """language -> unit prototype, from (text, lang) rows with both not null.

    About ``train_rows`` rows, drawn by a hash of the text, are used: a bounded training sample. Every task sums its
    rows; only one vector per language and task is shuffled, and one per language reaches the driver.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    total = rows.select(F.count("*")).first()[0]
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for s, texts in _texts(b.column(0)):
                units = np.rint(bundles(texts) * UNIT).astype(np.int64)
                for lang, u in zip(b.column(1)[s:s + len(texts)].to_pylist(), units):
                    sums[lang] = sums.get(lang, 0) + u
        names = [x for x in sums for _ in range(DIMENSIONS)]
        values = np.concatenate([*sums.values()]) if sums else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(range(DIMENSIONS)) * len(sums), pa.int32()), pa.array(values, pa.int64())], ["lang", "k", "v"])

    sums = rows.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    for lang, cells in sums.groupBy("lang").agg(F.collect_list(F.struct("k", "v")).alias("c")).collect():  # one vector per language
        v = np.zeros(DIMENSIONS)
        for k, x in cells:
            v[k] = x
        if v.any():
            out[lang] = (v / np.linalg.norm(v)).tolist()
    return out


def identify(docs: DataFrame, profiles: dict[str, list[float]], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with _lang and _score (the cosine, 0 to 1), from the text alone.

    Null texts and texts without a letter get ``und`` and 0; so does everything when no language was learned. Equal
    texts get equal results; ties go to the language first in the alphabet; an empty table gives an empty one.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], np.float64).reshape(-1, DIMENSIONS)

    def run(batches):
        for b in batches:
            langs, scores = [], []
            for _, texts in _texts(b.column(len(keep))):
                units = bundles([x or "" for x in texts])
                cos = units @ matrix.T if names else np.zeros((len(texts), 1))
                best = cos.argmax(axis=1)
                for row, k in enumerate(best):
                    known = bool(names) and bool(units[row].any())
                    langs.append(names[k] if known else "und")
                    scores.append(float(min(1.0, max(0.0, cos[row, k]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "_lang", "_score"])

    given = docs.select(*keep, F.col(text_col).alias("_text"))
    return given.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in given.schema[:-1]), StructField("_lang", StringType()), StructField("_score", DoubleType())]))


def held_out(name: str = "doc_id"):
    """Rows kept from training: crc32 modulo 5 is 0 (null ids are never trained on)."""
    return F.coalesce(remainder(name, 5) == 0, F.lit(True))


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows that are not held out, given for all."""
    profiles = prototypes(docs.where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def known_language(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Documents with a recognised language: not ``und`` and a cosine of at least ``least``. Columns stay as they are, whatever their names."""
    profiles = prototypes(docs.where(~held_out()))
    return identify(whole_rows(docs), profiles, ("doc",)).where(F.col("_lang") != "und").where(F.col("_score") >= least).select("doc.*")
