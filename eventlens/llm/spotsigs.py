"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor and the next content words after it. A text's fingerprint is the set of its signatures; texts
are alike by the Jaccard similarity of these sets, and sets whose sizes differ too much cannot be alike, so they are
compared within neighbouring size partitions only.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import whole_text
from eventlens.plans.stash import stash

WORD = re.compile(r"\w+")
CHAIN = 2
#: Common words (fixed values) of English, German, French and Spanish.
ANCHORS = frozenset("""
a an and are as at be by for from has have in is it of on or that the this to was were which with
am auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht sich sie und von war zu
au aux avec ce dans de des du elle en est et il la le les par pas pour que qui se sur un une
al como con del el ella en es las lo los más no para por que se su un una y
""".split())


def signatures(text: str, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> frozenset[str]:
    """Distinct signatures of a text. A text without a whole chain after an anchor takes every word as an anchor of its own
    chain; one without words is its own signature, and an empty one has none."""
    words = WORD.findall(text.lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in anchors:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    if chain == 2:
        found = {f"{a} {content[k]} {content[k + 1]}" for a, k in spots if k <= last}
    else:
        found = {" ".join((a, *content[k:k + chain])) for a, k in spots if k <= last}
    if found:
        return frozenset(found)
    if words:
        return frozenset(" ".join(words[k:k + chain + 1]) for k in range(max(1, len(words) - chain)))
    return frozenset([text]) if text else frozenset()


def fingerprint(found: frozenset[str]) -> str:
    """Size and digest of a signature set; equal for equal sets."""
    h = blake2b(digest_size=16)
    for x in sorted(found):
        h.update(x.encode("utf-8", "surrogatepass") + b"\n")
    return f"{len(found)}-{h.hexdigest()}"


def likeness(a: frozenset[str], b: frozenset[str], least: float = 0.0) -> float:
    """Jaccard similarity; 0 without looking at the sets if their sizes keep it below ``least``. Two empty sets are alike."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def size_partition(size: int, least: float) -> int:
    """Number of the size partition: partitions are as wide as the similarity allows, so partners lie in the same or the next."""
    from math import log

    return int(log(max(size, 1)) / -log(least)) if 0 < least < 1 else 0


def fingerprints(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, size_partition, signatures) of every whole text: the operator's real outputs."""

    def run(batches):
        for b in batches:
            found = [signatures(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fingerprint, found), pa.string()), pa.array([size_partition(len(f), least) for f in found], pa.int32()),
                                              pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["doc_id", "fingerprint", "size_partition", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(run, "doc_id long, fingerprint string, size_partition int, signatures array<string>")


def edited_neighbours(docs: DataFrame, rows_in_part: int | None = None) -> DataFrame:
    """Each document against an edited self and against the next document by ascending doc_id (after the last: the first).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next text. Ids are
    cut into ranges at quantiles; each range also gets the first document of the following range, so the texts move in
    one shuffle and a range is read as a stream that holds two documents at a time. Ties: rows of one id follow each
    other by their text; null ids come first. Null text: empty. A single row is its own next document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"))
    parts = rows_in_part or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.stat.approxQuantile("o", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]

    def places(batches):
        from bisect import bisect_right

        for b in batches:
            o = b.column("o").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(cuts, x) for x in o], pa.int32())], [*b.schema.names, "part"])

    # The first id of each range: one row per range.
    first = {r.part: r.o for r in ids.mapInArrow(places, "o long, part int").groupBy("part").agg(F.min("o").alias("o")).collect()}
    order = sorted(first)
    before = {first[p]: order[k - 1] for k, p in enumerate(order)}

    def deal(batches):
        from bisect import bisect_right

        for b in batches:
            o = b.column(2).to_pylist()
            own = [bisect_right(cuts, x) for x in o]
            also = [k for k, x in enumerate(o) if x in before]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([False] * len(o), pa.bool_())], ["doc_id", "text", "o", "part", "guest"])
            if also:
                few = b.take(pa.array(also))
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array([before[o[k]] for k in also], pa.int32()), pa.array([True] * len(also), pa.bool_())],
                                                 ["doc_id", "text", "o", "part", "guest"])

    dealt = rows.withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 63)))).mapInArrow(deal, "doc_id long, text string, o long, part int, guest boolean")
    placed = dealt.repartition(max(len(order), 1), "part").sortWithinPartitions("part", "guest", "o", "text")

    def run(batches):
        from hashlib import sha256

        held = None  # (part, doc_id, text, signatures), waiting for its next document
        for b in batches:
            out = []
            for part, guest, i, x in zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                if held is not None and held[0] != part:
                    held = None
                if guest and held is None:
                    continue  # a further row of the guest's id
                text = x.as_py()
                own = signatures(text)
                if held is not None:
                    _, h_id, h_text, h_own = held
                    n = len(h_text)
                    edited = h_text[:n - n // 2] + text[:n // 2]
                    other = signatures(edited) if edited != h_text else h_own
                    out.append((h_id, n, sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(h_own), fingerprint(other), likeness(h_own, other), likeness(h_own, own)))
                held = None if guest else (part, i, text, own)
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], COLUMNS)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of distinct signature sets alike by at least ``least``; a and b are the smallest ids of their sets.

    Equal sets are one row. A set is listed under its rarest signatures, as many as a partner must share at least one
    of (prefix filter); listed sets meet within the same or the next size partition and are checked on the whole sets.
    """
    from math import ceil

    made = stash(fingerprints(docs, least).where("doc_id IS NOT NULL AND size(signatures) > 0"))
    sets = stash(made.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "size_partition", "signatures")).alias("r")).selectExpr("r.doc_id AS id", "r.size_partition AS part", "r.signatures AS sigs"))
    single = sets.select("id", "part", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = single.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = single.join(rare, "sig").groupBy("id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    listed = ranked.select("id", "part", "n", F.explode(F.expr(f"slice(s, 1, int(n - ceil(n * {least}) + 1))")).alias("e")).where("e.df > 1").select("id", "part", "n", "e.sig")
    right = listed.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = (listed.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", "part").join(right, ["sig", "part"])
           .where(f"(a <> b) AND least(na, nb) >= {least} * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = met.join(sets.selectExpr("id AS a", "sigs AS sa"), "a").join(sets.selectExpr("id AS b", "sigs AS sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= least)
