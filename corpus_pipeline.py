"""From raw documents to training batches: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statera.llm import exact_dedup, mixing, packing, parity_join, quality, shared


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below one half."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest original of texts that are equal but for white space."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts with five-word shingle similarity of 0.8 or more."""
    return parity_join.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source up to its target, some more than once; the one at the cut is taken whole."""
    return mixing.take(docs)


def length_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens (words), bucket, padded_length, batch and slot of every document taken."""
    sized = docs.select("doc_id", shared.n_words().alias("n_tokens"))
    return packing.pack(shared.stored(sized, "sized"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mixture", source_mixture),
    ("length_batches", length_batches),
]

#: no SQL: the classifier is trained
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored_alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
