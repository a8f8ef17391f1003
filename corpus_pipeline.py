"""A corpus pipeline of five stages over the operators of remnant.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  Null,
empty and blank texts go in the first stage, which samples only texts with words.  Extra
columns of docs are carried along up to the last stage, which returns its own columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remnant.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup
from remnant.llm.common import table
from remnant.sources.storage import shared_dir


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality_classifier.keep_sampled(docs, table(spark, sf_dir, "labels"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and the sampled pieces of each document of the mix.

    Rows of a document that is there twice have equal pieces, as their key is the id.
    """
    rows = docs.select("doc_id", "source", sentencepiece_codec.encode(F.col("text"), F.col("doc_id")).alias("pieces"))
    return rows.select("doc_id", "source", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"), "pieces")


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("simhash near-dedup", simhash_dedup_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The learned stages and sampled pieces cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    top = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
