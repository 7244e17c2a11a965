"""Reading event logs: lines, arrays, gzip and summaries; any path that Spark's file systems know.

Readers return the columns of ``event_schema`` plus ``file``.  A record that is not JSON has only
``_corrupt_record``; blank lines are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlens.plans.stash import stash
from eventlens.schema import CORRUPT, SUMMARY_DDL, event_schema
from eventlens.sources.arrays import array_elements

Paths = str | list[str]


def scan_ndjson(spark: SparkSession, paths: Paths, strict: bool = False) -> DataFrame:
    """One JSON object per line; large files are read in parallel splits."""
    # FAILFAST needs no corrupt-record column
    reader = spark.read.schema(event_schema()).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    # a folder such as app_id=x is a place, not a column
    reader = reader.option("recursiveFileLookup", True)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(paths).select("*", F.col("_metadata.file_path").alias("file"))


def scan_json_array(spark: SparkSession, paths: Paths, strict: bool = False) -> DataFrame:
    """One JSON array per file; large files are read in parallel splits (see ``arrays``).

    The events are parsed here, once, and stored: what is made of them reads only the columns it needs, and neither cuts nor parses again.
    """
    return stash(parse_lines(array_elements(spark, paths), strict).select(*event_schema().names, "file"))


def scan_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(value, file): non-blank lines, for parsing that keeps the text (see ``parse_lines``)."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.filter("trim(value) <> ''")


def parse_lines(lines: DataFrame, strict: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Parse a ``value`` column; other columns pass through and the text is kept as ``raw``.

    Of records of many fields most time goes into those that nobody reads; with ``fields`` only these are parsed, as in a scan
    of JSON files by Spark, and what is wrong with the others is not seen.

    The record is unpacked by ``inline``: a filter on its fields stays behind it, while one on a projection would be moved
    before it with a second parse of every text.
    """
    schema = event_schema()
    if fields is not None:
        schema = StructType([f for f in schema if f.name in (*fields, CORRUPT)])
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rest = [c for c in lines.columns if c != "value"]
    filled = lines.filter("trim(value) <> ''")  # not by its length, for which every text would be read through
    return filled.select(*rest, F.col("value").alias("raw"), F.inline(F.array(F.from_json("value", schema, options))))


def scan_gzip(spark: SparkSession, paths: Paths, partitions: int | None = None) -> DataFrame:
    """Gzip-compressed lines.

    A compressed file cannot be split, so the lines of few files are spread over ``partitions`` before the costly JSON
    parsing. Files that are read by as many tasks or more are parsed by these, without a shuffle of their text.
    """
    lines = scan_lines(spark, paths)
    spread = partitions and lines.rdd.getNumPartitions() < partitions
    return parse_lines(lines.repartition(partitions) if spread else lines)


def _first_characters() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function that opens each file just far enough to see its first character that is not blank.

    It is made here so that it travels to the workers whole; they need no copy of this package.
    """

    def run(batches):
        import bz2
        import zlib

        import pandas
        from pyarrow import fs

        for batch in batches:
            firsts = []
            for path in batch["file"]:
                if path.endswith((".zst", ".zstd", ".lz4", ".lzo", ".snappy", ".deflate")):
                    raise ValueError(f"compression of {path} is not supported; use gzip, bzip2 or plain text")
                uri = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
                store, inner = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
                unzip = zlib.decompressobj(47) if path.endswith(".gz") else bz2.BZ2Decompressor() if path.endswith(".bz2") else None
                first = ""
                with store.open_input_stream(inner, compression=None) as stream:
                    while not first:
                        chunk = stream.read(4096)
                        if not chunk:
                            break
                        first = (unzip.decompress(chunk) if unzip else chunk).decode("utf-8", "ignore").lstrip("\ufeff \t\r\n")[:1]
                firsts.append(first)
            yield pandas.DataFrame({"file": batch["file"], "first": firsts})

    return run


def detect_format(spark: SparkSession, paths: Paths, peek: bool = True) -> DataFrame:
    """(file, format) with format ``array`` or ``ndjson`` from the first character that is not blank.

    By default the tasks open each file and read a few bytes, so the cost grows with the number of files and not with
    their size.  ``peek=False`` finds the character with a text scan, for stores that only Spark can open.
    """
    if peek:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("file"))
        firsts = files.mapInPandas(_first_characters(), "file STRING, first STRING")
    else:
        lines = spark.read.option("recursiveFileLookup", "true").text(paths).selectExpr(
            "_metadata.file_path AS file", "_metadata.file_block_start AS start", "monotonically_increasing_id() AS line", "left(ltrim(value), 1) AS first")
        firsts = lines.filter("first <> ''").groupBy("file").agg(F.expr("min_by(first, struct(start, line)) AS first"))
    return firsts.selectExpr("file", "IF(first = '[', 'array', 'ndjson') AS format")


def _by_format(spark: SparkSession, path: str, peek: bool, readers: dict[str, Callable[[Paths], DataFrame]]) -> DataFrame:
    """Union of the readers over the files of their format.

    The file names per format go to the reader the way Spark's own file listing does; a folder of one
    format is read by its own path.
    """
    found = [(r["format"], r["file"]) for r in detect_format(spark, path, peek).collect()]
    kinds = sorted({k for k, _ in found}) or ["ndjson"]
    parts = [readers[kind](path if len(kinds) == 1 else [f for k, f in found if k == kind]) for kind in kinds]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def scan_events(spark: SparkSession, path: str, strict: bool = False, peek: bool = True) -> DataFrame:
    """Events of a file or folder in which arrays, lines and compressed files may be mixed."""
    return _by_format(spark, path, peek, {"array": lambda p: scan_json_array(spark, p, strict), "ndjson": lambda p: scan_ndjson(spark, p, strict)})


def scan_records(spark: SparkSession, path: str, peek: bool = True) -> DataFrame:
    """(value, file): the text of every record under ``path``, for ``parse_lines``; formats may be mixed as in ``scan_events``."""
    return _by_format(spark, path, peek, {"array": lambda p: array_elements(spark, p), "ndjson": lambda p: scan_lines(spark, p)})


def scan_summarized(spark: SparkSession, paths: Paths) -> DataFrame:
    """Pre-aggregated logs, one object per file: one row per stage."""
    logs = spark.read.schema(SUMMARY_DDL).option("multiLine", True).json(paths)
    return logs.selectExpr("applicationId AS app_id", "explode(stages) AS s").selectExpr("app_id", "s.*")


def summarized_tasks(stages: DataFrame) -> DataFrame:
    """Every summarised stage expanded to ``numTasks`` task rows that carry the averages."""
    def share(x: str) -> str:
        return f"coalesce({x}, 0) / CAST(numTasks AS DOUBLE)"

    return stages.filter("numTasks > 0").selectExpr("*", "explode(sequence(1, numTasks)) AS n").selectExpr(
        "app_id", "stageId AS stage_id", "0L AS stage_attempt", "n AS task_id", "'summary' AS executor_id", "0L AS launch_ms",
        "coalesce(taskMetrics.avgTaskDurationMs, 0) AS finish_ms", "coalesce(taskMetrics.avgTaskDurationMs, 0) AS duration_ms",
        f"{share('executorRunTime')} AS run_ms", f"{share('executorRunTime')} * coalesce(taskMetrics.avgCpuUtilization, 0) * 1e6D AS cpu_ns",
        f"{share('gcTime')} AS gc_ms", f"{share('memoryBytesSpilled')} AS mem_spill_bytes", f"{share('diskBytesSpilled')} AS disk_spill_bytes")
