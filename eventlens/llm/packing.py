"""Sequence packing by minimum bin slack.

Documents are cut at multiples of the window; what remains is a multiset of lengths, one count per length, whose size
does not depend on the number of documents. For each window the largest remaining length is set, and a subset-sum
dynamic programme over the counts (a Python integer as bitset, one shift per binary part of a count) finds the filling
closest to capacity; going back through the bitsets gives the counts used. A filling is repeated as often as the counts
allow. Pieces then find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.bpe import LETTER_OF
from eventlens.llm.common import whole_text
from eventlens.llm.words import Cache, WordFile, windows
from eventlens.plans.stash import stash

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Ranks are counted in so many parts of each length, so that a common length is no single task.
PARTS = 256


class LibraryIds:
    """Ids of a tokenizer file by the ``tokenizers`` library, whose model sees each new word once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.file, self.model = WordFile(path), Tokenizer.from_file(path).model
        self.cache = Cache(self._word)

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize("".join([LETTER_OF[b] for b in word.encode("utf-8", "surrogatepass")]))], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        cache, found = self.cache, []
        for window in windows(text):
            for is_added, part in self.file.segments(window):
                if is_added:
                    found.append(np.array([self.file.added[part]], "<u4").tobytes())
                else:
                    found += [cache[word] for word in self.file.words(self.file.normal(part))]
        return np.frombuffer(b"".join(found), "<u4")


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def pieces_of(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of every whole text: its ids and ``end_id``, cut at multiples of ``window``. Null text: empty."""

    def run(batches):
        ids_of = library_ids(path)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([ids_of.encode(x.as_py()), end])
                for s in range(0, len(ids), window):
                    part = ids[s:s + window]
                    rows.append((i, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` whose sum is closest to ``room`` from below: length -> copies."""
    steps: list[tuple[int, int, int]] = []  # (length, copies of this part, bitset before it)
    bits, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, bits))
            bits |= (bits << (length * part)) & mask
            left -= part
            part *= 2
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(counts: dict[int, int], window: int = 4096) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots for every piece: (length, first rank, end rank, copies in a window, first sequence, first offset), and the number of windows.

    At most one repeated filling per change of the counts; each takes at least one length below what it uses.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = {}
    slots, sequence = [], 0
    while counts:
        top = max(counts)
        counts_left = dict(counts)
        counts_left[top] -= 1
        used = fill({n: c for n, c in counts_left.items() if c and n <= window - top}, window - top)
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // u for n, u in used.items())
        offset = 0
        for n, u in sorted(used.items(), reverse=True):
            first = taken.get(n, 0)
            slots.append((n, first, first + u * times, u, sequence, offset))
            taken[n] = first + u * times
            offset += n * u
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return slots, sequence


def pack(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """Pieces with sequence_id and offset.

    ``pieces`` has doc_id, start, length (1 to ``window``); more columns are kept. It is read twice, so pass a stored
    table. The driver sees one count per length (at most ``window``); the slots, a few for each length, go along with
    the task. Ties: pieces of equal length are ranked by part, doc_id and start; repeated rows take a place each. An
    empty table gives an empty one.
    """
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS))
    split = pieces.withColumn("_part", part)
    by_part = split.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    by_part = stash(by_part)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_part.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_first"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("_n")).collect()}
    slots, _ = plan(counts, window)
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 6)
    keys = table[:, 0] << 40 | table[:, 1]
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start")) - 1
    ranked = split.withColumn("_local", rank).join(firsts, ["length", "_part"]).withColumn("_rank", F.col("_local") + F.col("_first")).drop("_part", "_local", "_first")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            row = table[np.searchsorted(keys, length << 40 | rank, "right") - 1] if len(table) else np.zeros((0, 6), np.int64)
            at = rank - row[:, 1]
            sequence, offset = row[:, 4] + at // np.maximum(row[:, 3], 1), row[:, 5] + at % np.maximum(row[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their sequences; texts are tokenised once, and only the small pieces are stored."""
    return pack(stash(pieces_of(docs, path, window, end_id)), window)
