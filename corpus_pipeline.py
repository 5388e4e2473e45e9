"""The corpus pipeline: toxicity, exact dedup, near-dedup, personal data, packing.

Each stage takes all that its predecessor kept; `run` writes each result as Parquet in the shared folder and
reads it again as the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import exact_dedup, packing, pii, queries, shared, simhash, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, queries.table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all documents stay."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences: one row per piece."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("pii", private), ("packing", packed)]

#: No stage but exact dedup can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
