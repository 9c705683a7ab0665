"""The corpus pipeline: five stages over the documents, each written as Parquet and read by the next.

Each stage but the last returns the columns of documents. Stages with two branches over their input
(training and applying a model) read the files the stage before has written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import byte_bpe, decontaminate, quality_knn, secrets, simhash_dedup
from tallyloom.llm.common import Scratch
from tallyloom.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_knn.keep_good(docs, quality_knn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.keep_clean(docs, decontaminate.indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact(docs, secrets.train(secrets.default_samples(spark).unionAll(secrets.ordinary_words(docs))), chars_col="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text that is left."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]

#: The stages train models and compare texts beyond what SQL expresses; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between two is kept in the shared folder until the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        kept.drop_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
