"""Watched tables, source contracts and column maps as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwarden.functions.ids import short_name

REGISTRY_SCHEMA = "table_fqn string, watch boolean, key_column string, owner string"
COLUMN_MAP_SCHEMA = ("model string, table_fqn string, dedupe_key string, ordinal int, alias string, source string, "
                     "expr string, type string, tests array<string>, description string")
CONTRACT_SCHEMA = "table_fqn string, column_name string, data_type string, description string, meta map<string,string>"


def watch_registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def watched(registry: DataFrame) -> DataFrame:
    return registry.where("watch").select("table_fqn", "key_column", "owner")


def with_owner(rows: DataFrame, registry: DataFrame, table_col: str = "table_fqn") -> DataFrame:
    """Owner of the table each row names: by its full name, else by the last segment where one watched table ends in it."""
    full = F.upper("table_fqn")
    owners = watched(registry).groupBy(full.alias("_full")).agg(F.min("owner").alias("_owner"))
    short = (owners.groupBy(F.upper(short_name(F.col("_full"))).alias("_short"))
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_owner").alias("_by_short")).where("_n = 1").drop("_n"))
    return (rows.withColumns({"_full": F.upper(table_col), "_short": F.upper(short_name(F.col(table_col)))})
            .join(owners, "_full", "left").join(short, "_short", "left")
            .withColumn("owner", F.coalesce("_owner", "_by_short")).drop("_full", "_short", "_owner", "_by_short"))


def column_map(spark: SparkSession, model: str, table: str, dedupe_key: str | None, columns: list[dict]) -> DataFrame:
    rows = [(model, table, dedupe_key, i, c["alias"], c.get("source"), c.get("expr"), c["type"], c.get("tests", []),
             c.get("description")) for i, c in enumerate(columns, 1)]
    return spark.createDataFrame(rows, COLUMN_MAP_SCHEMA)


def source_contract(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documented columns of the sources: (table, column, type, description, meta)."""
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)
