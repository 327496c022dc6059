"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. toxicity: documents predicted toxic go.
2. language: documents whose language is not recognised with enough confidence go.
3. near duplicates: one document of each SimHash group stays, the one with the smallest id.
4. secrets: every secret in the text, also in encoded layers, is replaced by a marker.
5. packing: what is left is packed into sequences of 4096 tokens.

Each function takes (spark, docs, sf_dir). All but the last return the columns of `documents`. Null and empty texts pass the first stage and go in the
second, as they have no language; empty tables pass through; extra columns are kept until the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadwarden.llm import language, packing, secrets, simhash, toxicity
from loadwarden.llm.common import small_batches, table
from loadwarden.session import write_through


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learning_fold()))


def drop_unrecognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_recognised(docs, language.train(docs, language.learning_fold()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unrecognised), ("near duplicates", drop_near_duplicates), ("secrets", remove_secrets),
          ("packing", pack)]

#: Trained models, fingerprints and tokens cannot be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
