"""Near-duplicates by MinHash with odd sketches.

MinHash samples are cut into bands; documents that share a band are candidates. The samples are also folded into a
parity bitmap (an odd sketch): the population count of two bitmaps' XOR estimates how many samples differ, precisely
where similarity is high, so most false candidates fall before any set is read. What is left is confirmed on the full
shingle sets.

No group is expanded into pairs. Equal sets are one class. In each band's bucket every class is first compared with the
bucket's smallest class (a star); only where a bucket still holds several components are the remaining candidates
compared, in blocks of bounded size, each block pair in a task of its own that sends on a spanning forest of its links.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import components, whole_text
from eventlens.llm.words import Cache
from eventlens.plans.stash import stash

WORD = re.compile("[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
SAMPLES, BANDS, SKETCH_WORDS, BLOCK = 64, 16, 4, 400
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


_ODD = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64))
_ONE = {"word": None}


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(text: str, words_in: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words the whole sequence; none without words."""
    words = WORD.findall(text.translate(_UPPER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if _ONE["word"] is None:
        _ONE["word"] = Cache(_word_hash, 200_000)
    get = _ONE["word"]
    w = np.array([get[x] for x in words], np.uint64)
    n = min(words_in, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + w[k:len(w) - n + 1 + k])
    return np.unique(out)


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples: the least value under each of the multiply-add permutations, in slices of bounded size."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), 1024):
        part = hashes[s:s + 1024]
        low = np.minimum(low, (part * _ODD[:, None] + _ADD[:, None]).min(axis=1))
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of (position, sample) pairs as 64-bit words."""
    bit = mix(low + _ADD) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def most_different(similarity: float, deviations: float = 5.0) -> int:
    """Bits in which the sketches of two sets of at least this similarity may differ, five deviations allowed.

    2m of the samples' values differ on one side only; thrown into n bits, the expected number of odd ones is
    n (1 - (1 - 2/n) ** 2m) / 2.
    """
    m = SAMPLES * (1 - similarity) + deviations * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    n = 64 * SKETCH_WORDS
    odd = n * (1 - (1 - 2 / n) ** (2 * m)) / 2
    return int(odd + deviations * (odd * (1 - odd / n)) ** 0.5)


def signatures(docs: DataFrame, words_in: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands array<long>, sketch array<long>) of every whole text."""

    def run(batches):
        for b in batches:
            ns, keys, bands, sketches = [], [], [], []
            for x in b.column(1):
                h = shingles(x.as_py(), words_in)
                ns.append(len(h))
                keys.append(_set_key(h))
                if len(h):
                    low = samples(h)
                    rows = low.reshape(BANDS, -1)
                    band = np.zeros(BANDS, np.uint64)
                    for k in range(rows.shape[1]):
                        band = mix(band + rows[:, k])
                    bands.append(band.view(np.int64).tolist())
                    sketches.append(odd_sketch(low).view(np.int64).tolist())
                else:
                    bands.append([])
                    sketches.append([])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, longs), pa.array(sketches, longs)],
                                             ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(run, "doc_id long, n_shingles long, set_key string, bands array<long>, sketch array<long>")


def _may_link(percent: int) -> str:
    """Condition on (n, sketch, n2, sketch2): sizes and sketches allow the similarity."""
    bits = " + ".join(f"bit_count(sketch[{k}] ^ sketch2[{k}])" for k in range(SKETCH_WORDS))
    return f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND {bits} <= {most_different(percent / 100)}"


def _set_key(hashes: np.ndarray) -> str:
    return blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def _sets(wanted: DataFrame, docs: DataFrame, words_in: int) -> DataFrame:
    """(rep, hashes array<long>) of the wanted classes (rep, doc_id, set_key), made again from the text of one of their documents.

    The list grows with the corpus, so it is never broadcast: texts and ids meet in one shuffle. Where an id has several
    texts, the key of the set says which is meant; of equal rows one is taken.
    """

    def made(batches):
        for b in batches:
            found = [(rep, h.view(np.int64)) for rep, key, x in zip(b.column("rep").to_pylist(), b.column("set_key").to_pylist(), b.column("text")) if _set_key(h := shingles(x.as_py(), words_in)) == key]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["rep", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).join(wanted.hint("merge"), "doc_id").select("rep", "set_key", "text")
    return texts.mapInArrow(made, "rep long, hashes array<long>").groupBy("rep").agg(F.min("hashes").alias("hashes"))


def _reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets reach the similarity."""
    both = pairs.join(sets.selectExpr("rep AS a", "hashes AS ha"), "a").join(sets.selectExpr("rep AS b", "hashes AS hb"), "b").withColumn("common", F.expr("size(array_intersect(ha, hb))"))
    return both.where(f"100L * common >= {percent}L * (size(ha) + size(hb) - common)").select("a", "b")


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components among (low, rep, n, sketch, comp) rows that share a bucket; ``low`` is the bucket's smallest rep.

    Buckets that share a member form one crowd, so that each member and its set goes to one place, not to one for each
    band. A crowd is cut into blocks by hash, of about ``BLOCK`` members; a member goes to all block pairs of its
    block. A task sees two blocks, compares sketches and then sets, and sends on links between different components
    only, one for each pair of components it has not yet joined itself.
    """
    crowds = components(members.selectExpr("rep AS a", "low AS b")).selectExpr("node AS rep", "component AS crowd")
    one = members.groupBy("rep").agg(F.min(F.struct("n", "sketch", "comp")).alias("m")).selectExpr("rep", "m.n AS n", "m.sketch AS sketch", "m.comp AS comp").join(crowds, "rep")
    one = stash(one)
    size = one.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = (one.join(size, "crowd").join(sets, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "rep", "n", "sketch", "hashes"))
    most = most_different(percent / 100)

    def run(key, t):
        own = t.column("own").to_numpy()
        comp, rep, n = (t.column(c).to_numpy() for c in ("comp", "rep", "n"))
        sketch = np.array(t.column("sketch").to_pylist(), np.int64).reshape(-1, SKETCH_WORDS).view(np.uint64)
        sets_here = [x.values.to_numpy() for x in t.column("hashes")]
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[(comp[ys] != comp[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
            if len(ys):
                ys = ys[np.bitwise_count(sketch[ys] ^ sketch[x]).sum(axis=1) <= most]
            for y in ys:
                p, q = root(comp[x]), root(comp[y])
                if p != q and _reach(sets_here[x], sets_here[y], percent):
                    joined[max(p, q)] = min(p, q)
                    a.append(rep[x])
                    b.append(rep[y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.groupBy("crowd", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words_in: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: linked if 100 * intersection >= percent * union.

    Empty and null texts have no shingles and link with nothing. Repeated rows are copies like any other. Rows whose
    doc_id is null keep a null component and are kept. An id may come with several texts: equal sets are one class, whatever
    their ids, and classes are what is linked, so each row gets the component of its own text. Extra columns are not read. An
    empty table gives an empty one.
    """
    signed = stash(signatures(docs, words_in))
    signed_sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class is named by a number given once, where it is stored
    classes = stash(signed_sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "sketch", "n_shingles")).alias("r"))
                    .selectExpr("set_key", "monotonically_increasing_id() AS rep", "r.doc_id AS doc_id", "r.bands AS bands", "r.sketch AS sketch", "r.n_shingles AS n"))
    banded = classes.select("rep", "n", "sketch", F.posexplode("bands").alias("band", "value"))
    centre = F.min(F.struct("rep", "n", "sketch"))
    buckets = banded.groupBy("band", "value").agg(centre.alias("c"), F.count("*").alias("size")).where("size > 1")
    met = stash(banded.join(buckets.selectExpr("band", "value", "c.rep AS centre", "c.n AS n2", "c.sketch AS sketch2", "size"), ["band", "value"]))
    pairs = stash(met.where("rep <> centre").where(_may_link(percent)).selectExpr("rep AS a", "centre AS b").distinct())
    needed = pairs.selectExpr("a AS rep").union(pairs.selectExpr("b AS rep")).union(met.where("rep <> centre AND size > 2").select("rep")).distinct()
    sets = stash(_sets(classes.select("rep", "doc_id", "set_key").join(needed, "rep"), docs, words_in))
    edges = stash(_confirm(pairs, sets, percent))
    comp = stash(components(edges))
    # What is left: classes other than the centre, in buckets where those lie in more than one component.
    rest = (met.where("rep <> centre AND size > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .select("band", "value", "rep", "n", "sketch", F.coalesce("component", "rep").alias("comp")))
    mixed = rest.groupBy("band", "value").agg((F.min("comp") < F.max("comp")).alias("mixed"), F.min("rep").alias("low")).where("mixed").select("band", "value", "low")
    members = stash(rest.join(mixed, ["band", "value"]).select("low", "rep", "n", "sketch", "comp"))
    if not members.isEmpty():
        links = stash(_rest(members, sets, percent))
        if not links.isEmpty():
            comp = stash(components(comp.selectExpr("node AS a", "component AS b").union(links)))
    rooted = classes.select("set_key", "rep", "doc_id").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "doc_id", F.coalesce("component", "rep").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("_comp"))
    found = rooted.join(least, "root").select("set_key", "_comp")
    out = signed.drop("bands", "sketch").join(found, "set_key", "left")
    id_ = F.when(F.col("n_shingles") > 0, F.col("_comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), id_).alias("component_id"),
                      F.coalesce(F.col("doc_id") == id_, F.lit(True)).alias("kept"))
