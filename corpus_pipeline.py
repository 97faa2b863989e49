"""From raw documents to tokens: five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.cluster import dropped, scratch, written
from trailweave.llm import bpe, decontam, near_copies, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality ranking scores under its threshold."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 5-word shingles at a Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages beyond the coverage limit."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it by their kinds."""
    return pii.sanitised(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids."""
    return bpe.encoded(docs)


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("tokens", tokens_stage),
]

#: A learned ranking and a hash that DuckDB lacks come first, so SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; the last is returned as read.

    A stage's table goes when the next one is written, the last one with the application.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if before is not None:
            dropped(before)
        before = docs
    return docs
