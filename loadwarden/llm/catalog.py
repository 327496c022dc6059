"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwarden.llm import bpe, conversations, fill_middle, fingerprints, language, packing, quality, secrets, sentencepieces, simhash, token_files, toxicity, warc
from loadwarden.llm.common import table, whole_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL where it can give equal results; tests hold the other queries against brute force.
ORACLES: dict[str, str] = {"op4_warc": warc.SQL, "op12_fill_middle": fill_middle.SQL}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learning_fold())
    scored = toxicity.score(docs, model)
    return scored.withColumn("held_out", ~toxicity.learning_fold()).select("doc_id", "held_out", "score", "predicted")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs, language.learning_fold()))
    return found.withColumn("held_out", ~language.learning_fold()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(whole_table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(whole_table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply(table(spark, sf_dir, "documents"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(whole_table(spark, sf_dir, "documents"))


@query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(whole_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(whole_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(conversations.damage(whole_table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
