"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Defined cases are those of the operators: null and empty texts pass the classifier by their features, are one exact
group, have no near copies, stay once in the mix, and are packed with length 0; rows with a null doc_id are judged by
their text, kept by the near stage, and packed; rows that repeat doc_id and text end as one; texts of any length are
whole rows; columns beyond doc_id, text, lang and source are carried along whatever their names; an empty table
gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfabric.llm.exact_dedup import drop_exact_copies
from kinfabric.llm.minhash_dedup import drop_near_copies
from kinfabric.llm.mixing import mix_documents
from kinfabric.llm.packing import pack_documents
from kinfabric.llm.quality import drop_rejected
from kinfabric.llm.shared import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, n=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length, bucket, padded, batch, padding: each document in its batch."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

#: Neither the classifier nor the boundaries of the packing can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
