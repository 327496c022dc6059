"""Results of model builds and tests."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwarden.functions.ids import short_name

RESULTS_SCHEMA = "results array<struct<unique_id: string, status: string>>"
FAILED = ("error", "fail")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """unique_id, status of every result in the result documents under `path`."""
    return (spark.read.schema(RESULTS_SCHEMA).json(path, multiLine=True)
            .select(F.explode("results").alias("r")).select("r.unique_id", "r.status"))


def build_summary(results: DataFrame) -> DataFrame:
    """One row: models built, tests run, failures."""
    kind = F.substring_index("unique_id", ".", 1)
    return results.agg(F.count_if(kind == "model").alias("models_built"), F.count_if(kind == "test").alias("tests_run"),
                       F.count_if(F.col("status").isin(*FAILED)).alias("failed"))


def built_models(results: DataFrame) -> DataFrame:
    return (results.where(F.col("unique_id").startswith("model."))
            .select(short_name(F.col("unique_id")).alias("model"), "status"))
