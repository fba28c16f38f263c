"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedback_rank.llm.decontaminate import decontaminated
from feedback_rank.llm.jaccard import deduplicated
from feedback_rank.llm.language import in_known_languages, train_language_model
from feedback_rank.llm.mixing import mixed_documents
from feedback_rank.llm.queries import tokenizer_path
from feedback_rank.llm.token_files import read_tokens, write_tokens
from feedback_rank.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages that the labelled ones teach, mixed or not.

    Those go that have no letters, or most of them in untaught scripts or in spans like letters at random.
    """
    return in_known_languages(docs, train_language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold neither half of a benchmark item's words nor fifty in a row."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files written."""
    path = scratch_path(spark, "pipeline-tokens")
    write_tokens(docs, path, tokenizer_path())
    return read_tokens(spark, path, with_ids=False)
