"""From raw documents to token files, in stages that each write their result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedback_rank.llm import stages
from feedback_rank.session import scratch_path

STAGES = [
    ("language", stages.language),
    ("near duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("token files", stages.token_files),
]

#: the stages cannot be told in SQL; tests hold each against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
