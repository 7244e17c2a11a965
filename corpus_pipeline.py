"""A training-data pipeline over ``documents``: language, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of documents. ``run`` writes each result as Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.langid import known_language
from eventlens.llm.oddsketch import near_duplicates
from eventlens.llm.packing import packed_documents
from eventlens.llm.queries import table, tokenizer_path
from eventlens.llm.secrets import masked
from eventlens.llm.toxicity import harmless
from eventlens.plans.stash import stash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; texts without a letter go."""
    return known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents scored below the toxicity threshold; labels come from ``labels``."""
    return harmless(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8): that with the smallest id.

    Rows are numbered where they are stored, so documents that share an id, or have none, are told apart; a document without
    words stays.
    """
    rows = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"), 80).selectExpr("doc_id AS row", "component_id")
    order = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", "row")
    kept = rows.select("row", order.alias("o")).join(groups, "row").groupBy("component_id").agg(F.min("o").alias("o")).select("o.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packed_documents(docs, tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]
#: Trained models and tokenising cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
