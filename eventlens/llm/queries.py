"""Registered queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm.centroids import oracle_sql as centroid_sql

TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.langid import predicted

    return predicted(table(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.surrogates import replaced

    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.multiindex import linked

    return linked(table(spark, sf_dir, "embeddings"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.spotsigs import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.oddsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.toxicity import predicted

    return predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.htmltree import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings")).drop("n_distances")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"), piece_model_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_language, op3_surrogates, op4_multi_index, op5_spotsigs, op6_packing, op7_minhash, op8_toxicity, op9_html_tree, op10_bpe,
                                    op11_whitening, op12_centroids, op13_pieces, pipeline)
}
ORACLES: dict[str, str] = {"op12_centroids": centroid_sql()}
