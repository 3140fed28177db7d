"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the last return the
columns of ``docs``; the last adds ``shard`` and ``slot``.  Null texts and ids, repeated rows and
empty tables are handled as each operator's module states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plexus.llm import decontaminate, mixing, quality, shards, simhash
from plexus.plans.tables import shared_root


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate class, the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that benchmark items contaminate."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until the languages' expected token shares meet their targets."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to eight shards of nearly equal bytes and number them."""
    return shards.place(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", source_mixing),
    ("sharding", sharding),
]

#: The classifier, the fingerprints and the fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
