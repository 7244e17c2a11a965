"""Elements of JSON arrays of any size, read by many tasks.

A file is cut at its closing braces, which Spark's text source does in parallel splits of bounded size. Outside of strings a piece
changes the nesting depth by a number that follows from its brackets; which parts are outside follows from the quotes before it.
So every piece, and every split, is a small transition: (parity of quotes, change of depth if it starts outside a string, the
same if it starts inside). Transitions compose, so a prefix over the splits of a file gives the state in which each begins, and
a second reading cuts the elements: one ends where a brace brings the depth back to 1.

Only the ends of splits meet in a shuffle, where an element lies on both sides. Where no file is cut into several splits, each is
read once, and its elements go from the task that cuts them to whatever comes next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.plans.stash import stash

#: Splits whose states are sent to all tasks; each row has about 100 bytes and stands for a split (128 MB by default).
MANY_SPLITS = 1_000_000
#: Longest text put together from several splits; a longer one is returned in its parts.
LONGEST = 1 << 28

def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block, id, size, whole_file): the text before each closing brace; ``block`` and ``id`` give its place, ``whole_file`` says that the split is all of its file."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "}").text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
                       F.col("_metadata.file_size").alias("size"), (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole_file"))


def several_splits(text: DataFrame) -> bool:
    """Whether Spark reads a file of ``text`` in several splits, by its plan; nothing is read for it."""
    return any(f.length() < f.fileSize() for p in text._jdf.queryExecution().toRdd().partitions() for f in p.files())


def transitions(values: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each piece: parity of its quotes, openings less closings outside of strings if it starts outside, and if it starts inside; and the bytes of all with a brace each.

    All pieces of the array are looked at together, as bytes: in UTF-8 none of these characters is part of another one.
    """
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + n + 1]
    text = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    first = offsets - offsets[0]
    quotes = np.flatnonzero(text == 34)
    slashes = np.flatnonzero(text == 92)
    if len(slashes) and len(quotes):  # a quote behind an odd run of backslashes is not one; a run ends with its piece
        starts = np.flatnonzero(np.r_[True, np.diff(slashes) > 1] | np.isin(slashes, first))
        after = slashes[np.r_[starts[1:] - 1, len(slashes) - 1]] + 1
        odd = after[np.diff(np.r_[starts, len(slashes)]) % 2 == 1]
        quotes = quotes[~np.isin(quotes, np.setdiff1d(odd, first))]
    up, down = np.flatnonzero((text == 91) | (text == 123)), np.flatnonzero(text == 93)
    before = np.searchsorted(quotes, first)  # quotes before each piece
    counts = []
    for at in (up, down):
        piece = np.searchsorted(first, at, "right") - 1
        within = (np.searchsorted(quotes, at) - before[piece]) % 2 == 1
        counts.append([np.bincount(piece[within == h], minlength=n) for h in (False, True)])
    return np.diff(before) % 2, counts[0][0] - counts[1][0], counts[0][1] - counts[1][1], len(text) + n


def _runs(batch: pa.RecordBatch):
    """Parts of a batch that belong to one split, in order."""
    file, block = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
    cut = np.flatnonzero(np.r_[True, (np.diff(file) != 0) | (np.diff(block) != 0)])
    for a, b in zip(cut, [*cut[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def _steps(parity, outside, inside, state: int):
    """Per piece: the state behind it (1: in a string), and the change of depth with its closing brace."""
    behind = (np.cumsum(parity) + state) % 2
    before = np.r_[state, behind[:-1]]
    return behind, np.where(before == 1, inside, outside) - (behind == 0)


def split_states(found: DataFrame) -> DataFrame:
    """(file, block, state, depth, ordinal, last, closed, lost) of every split of the files that have several.

    ``state`` and ``depth`` are those at its begin, ``ordinal`` is the number of elements that end before it, ``closed``
    says that the file ends in a closing brace, ``lost`` that the nesting broke off before this split.
    """

    def run(batches):
        key, have = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "bytes": have["bytes"], "parity": have["parity"], "size": have["size"],
                                                **{f"{n}{h}": have[n][h] for n in ("change", "low", "ends") for h in (0, 1)}}], schema)

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("parity", pa.int32()), ("size", pa.int64()),
                            *((f"{n}{h}", pa.int64()) for n in ("change", "low", "ends") for h in (0, 1))])
        for batch in batches:
            for part in _runs(batch):
                at = (part.column("file")[0].as_py(), part.column("block")[0].as_py())
                if at != key:
                    if key:
                        yield row()
                    key, have = at, {"bytes": 0, "parity": 0, "change": [0, 0], "low": [1 << 40] * 2, "ends": [0, 0], "size": part.column("size")[0].as_py()}
                parity, outside, inside, size = transitions(part.column("value"))
                for h in (0, 1):
                    behind, step = _steps(parity, outside, inside, (h + have["parity"]) % 2)
                    depth = have["change"][h] + np.cumsum(step)
                    here = depth[behind == 0]
                    if len(here) and here.min() <= have["low"][h]:
                        low = int(here.min())
                        have["ends"][h] = int((here == low).sum()) + (have["ends"][h] if low == have["low"][h] else 0)
                        have["low"][h] = low
                    have["change"][h] = int(depth[-1])
                have["parity"] = (have["parity"] + int(parity.sum())) % 2
                have["bytes"] += size
        if key:
            yield row()

    kinds = "file string, block long, bytes long, parity int, size long, " + ", ".join(f"{n}{h} long" for n in ("change", "low", "ends") for h in (0, 1))
    several = found.where("NOT whole_file").select("value", "file", "block", "size")
    splits = several.mapInArrow(run, kinds)
    file = Window.partitionBy("file")
    order = file.orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("state", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    chosen = known.select("*", *(F.when(F.col("state") == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}0")).alias(n) for n in ("change", "low", "ends")))
    deep = chosen.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    counted = deep.withColumn("n", F.expr("IF(low = 1 - depth, ends, 0L)")).withColumn("broken", F.expr("low < 1 - depth"))
    return counted.select("file", "block", "state", "depth", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.lead("block").over(order).isNull().alias("last"),
                          (F.sum("bytes").over(file) == F.col("size")).alias("closed"), F.coalesce(F.max("broken").over(before), F.lit(False)).alias("lost"))


def _object(values: pa.Array, ordinals: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Segments without the comma before them, on one line; and which of them are now a single object. The first one of an array is left as it is."""
    text = pc.ascii_ltrim_whitespace(values)
    lead = pc.and_(pc.starts_with(text, ","), pa.array(ordinals > 0))
    text = pc.replace_substring_regex(text, r"^,\s*", "", max_replacements=1)
    if pc.any(pc.or_(pc.match_substring(text, "\n"), pc.match_substring(text, "\r"))).as_py():  # line breaks are never in a string
        text = pc.replace_substring_regex(text, r"[ \t]*[\r\n]\s*", "")
    return text, pc.and_(lead, pc.starts_with(text, "{"))


def _cut(batches):
    """Segments of the array: text up to the brace that ends an element. ``done`` ones are a single object; what two splits share comes as parts.

    Pieces without the columns of ``split_states`` are those of files that are each a single split.
    """
    alone = {"state": 0, "depth": 0, "ordinal": 0, "last": True, "closed": None, "lost": False}
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("block", pa.int64()), ("value", pa.string()), ("whole", pa.bool_()), ("final", pa.bool_()), ("done", pa.bool_())])
    key, have = None, None

    def rows(ordinals, values, whole, final=False):
        n, done = len(values), pa.array([False] * len(values))
        whole = pa.array(whole, pa.bool_())
        if not final and n and ordinals[0] >= 0:
            text, single = _object(values, np.asarray(ordinals))
            done = pc.and_(single, whole)
            values = pc.if_else(done, text, values)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(ordinals, pa.int64()), pa.array([key[1]] * n, pa.int64()), values.cast(pa.string()),
                                           whole, pa.array([final] * n, pa.bool_()), done], schema=schema)

    def finish():
        """What is left behind the last element of a split. The last piece of a file has a brace only if the bytes add up to its size."""
        closed = not have["last"] or (have["closed"] if have["closed"] is not None else have["bytes"] == have["size"])
        text = "}".join(have["held"]) + ("}" if have["held"] and closed else "")
        if have["end_held"] and closed:
            yield rows([have["ordinal"]], pa.array([text]), [have["fresh"]])
            have.update(ordinal=have["ordinal"] + 1, fresh=True)
            text = ""
        if have["lost"]:
            yield rows([-1], pa.array([text]), [False])
        elif have["last"]:
            yield rows([have["ordinal"]], pa.array([text]), [have["fresh"]], True)
        elif text:
            yield rows([have["ordinal"]], pa.array([text]), [False])

    for batch in batches:
        for part in _runs(batch):
            at = (part.column("file")[0].as_py(), part.column("block")[0].as_py())
            if at != key:
                if key:
                    yield from finish()
                given = part.schema.names
                if "state" not in given and at[1]:
                    raise ValueError(f"{at[0]} was planned as one split and is read in several")
                first = {"size": part.column("size")[0].as_py()} | {c: part.column(c)[0].as_py() if c in given else v for c, v in alone.items()}
                key, have = at, first | {"held": [], "bytes": 0, "fresh": at[1] == 0 or (first["depth"] == 1 and not first["state"]), "end_held": False}
            if have["end_held"]:  # the piece held back was not the last one
                yield rows([have["ordinal"]], pa.array(["}".join(have["held"]) + "}"]), [have["fresh"]])
                have.update(held=[], ordinal=have["ordinal"] + 1, fresh=True)
            parity, outside, inside, size = transitions(part.column("value"))
            behind, step = _steps(parity, outside, inside, have["state"])
            depth = have["depth"] + np.cumsum(step)
            # the last piece may be the end of the file and lack its brace, so it cannot show damage
            broken = np.zeros(1, int) if have["lost"] else np.flatnonzero(((behind == 0) & (depth < 1))[:-1])
            stop = int(broken[0]) if len(broken) else part.num_rows
            ends = np.flatnonzero((behind == 0) & (depth == 1))
            ends = ends[ends < stop]
            have["end_held"] = bool(len(ends)) and ends[-1] == part.num_rows - 1
            if have["end_held"]:
                ends = ends[:-1]
            values = part.column("value")
            start = 0
            if len(ends) and have["held"]:
                yield rows([have["ordinal"]], pa.array(["}".join([*have["held"], *values.slice(0, int(ends[0]) + 1).to_pylist()]) + "}"]), [have["fresh"]])
                have.update(held=[], ordinal=have["ordinal"] + 1, fresh=True)
                start, ends = int(ends[0]) + 1, ends[1:]
            if len(ends):
                offsets = pa.array([start, *(ends + 1)], pa.int32())
                joined = pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(offsets, values), "}"), pa.scalar(""), "}")
                n = len(ends)
                yield rows(np.arange(have["ordinal"], have["ordinal"] + n), joined, [have["fresh"], *[True] * (n - 1)])
                have.update(ordinal=have["ordinal"] + n, fresh=True)
                start = int(ends[-1]) + 1
            have["held"] += values.slice(start).to_pylist()
            have["bytes"] += size
            have["state"], have["depth"] = int(behind[-1]), int(depth[-1])
            if len(broken) and not have["lost"]:
                have["lost"], have["end_held"] = True, False
            if have["lost"] and sum(map(len, have["held"])) > 1 << 24:
                yield rows([-1], pa.array(["}".join(have["held"]) + "}"]), [False])
                have["held"] = []
    if key:
        yield from finish()


_SEGMENTS = "file string, ordinal long, block long, value string, whole boolean, final boolean, done boolean"


def _elements(segments: DataFrame) -> DataFrame:
    """(value, file): what whole segments (file, ordinal, value, final, done) hold, row by row. Those of a negative ordinal are given as they are."""
    head = F.when(F.col("ordinal") == 0, F.regexp_replace("value", r"^\x{FEFF}?\s*\[", "")).otherwise(F.regexp_replace("value", r"^\s*,", ""))
    body = F.trim(F.regexp_replace(head, r"^\s+|\s+$", ""))
    text = F.when(F.col("final"), F.regexp_replace(body, r"\s*\]$", "")).otherwise(body)
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.array(text))
    values = (F.when(F.col("done"), F.array("value"))
              .when(F.col("ordinal") < 0, F.when(F.trim("value") != "", F.array("value")).otherwise(none))
              .when(F.col("final") & ~body.endswith("]"), F.array(F.when(body == "", "[").otherwise(body)))
              .when(~F.col("final") & text.startswith("{"), F.array(F.regexp_replace(text, r"\s*[\r\n]\s*", "")))  # line breaks are never in a string
              .when(text != "", listed).otherwise(none))
    return segments.select(F.explode(values).alias("value"), "file")


def array_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file): the text of every element of one JSON array per file.

    Elements that are objects keep their text, on one line; others are given as JSON. What cannot be read is given as it is: an element
    that breaks off, text behind the array. An array without its end always leaves one such record, ``[`` if nothing else is
    left. When the nesting is broken the rest of the file is given in parts. Blank files and empty arrays have no element.
    In a compressed file, whose true length is unknown, an array cut right behind an element loses that element's brace, so
    the element is such a record. Compressed files are read by one task each, others by one task a split.

    If no file has several splits, as with compressed files, every use of the result reads the files again and nothing is stored; else
    the segments are stored first.
    """
    found = pieces(spark, paths)
    if not several_splits(found):
        return _elements(found.select("value", "file", "block", "size").mapInArrow(_cut, _SEGMENTS))
    splits = stash(split_states(found))
    many = splits.count()
    states = F.broadcast(splits) if many <= MANY_SPLITS else splits
    at = found.join(states, ["file", "block"], "left").select(
        "value", "file", "block", "id", "size", F.coalesce("state", F.lit(0)).alias("state"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.coalesce("last", F.lit(True)).alias("last"), "closed",
        F.coalesce("lost", F.lit(False)).alias("lost"))
    if many > MANY_SPLITS:  # a join by shuffle: bring the pieces of a split together again, in order
        at = at.repartition("file", "block").sortWithinPartitions("file", "block", "id")
    segments = stash(at.mapInArrow(_cut, _SEGMENTS))
    parts = segments.where("NOT whole AND ordinal >= 0")
    sizes = parts.groupBy("file", "ordinal").agg(F.sum(F.length("value")).alias("chars"))
    sized = parts.join(sizes, ["file", "ordinal"])
    joined = (sized.where(F.col("chars") <= LONGEST).groupBy("file", "ordinal").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"), F.max("final").alias("final"))
              .selectExpr("file", "ordinal", "array_join(transform(parts, p -> p.value), '') AS value", "final", "false AS done"))
    long = sized.where(F.col("chars") > LONGEST).selectExpr("file", "-1L AS ordinal", "value", "false AS final", "false AS done")
    whole = segments.where("whole OR ordinal < 0").select("file", "ordinal", "value", "final", "done")
    return _elements(whole.unionByName(joined).unionByName(long))
