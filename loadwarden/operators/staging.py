"""Gated, mapped and deduplicated staging models, and the contract they must meet."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions.types import spark_cast_type
from loadwarden.operators.gate import gated

SYSTEM = ["_load_id", "_loaded_at"]


def model_columns(column_map: DataFrame, model: str) -> list[dict]:
    """Map rows of one model, in order; a config of a model's width."""
    rows = column_map.where(F.col("model") == model).orderBy("ordinal").collect()
    return [r.asDict(recursive=True) for r in rows]


def column_expression(c: dict) -> Column:
    source = F.expr(c["expr"]) if c.get("expr") else F.col(f"`{c['source']}`")
    return source.cast(spark_cast_type(c["type"])).alias(c["alias"])


def mapped(bronze: DataFrame, columns: list[dict]) -> DataFrame:
    """Bronze columns under their contract names and types; a value that does not fit fails the job."""
    return bronze.select(*[column_expression(c) for c in columns], *SYSTEM)


def latest_per_key(rows: DataFrame, key: str, order: tuple[str, ...] = ("_loaded_at", "_load_id")) -> DataFrame:
    """One row per key, latest load wins. The rank filter lets Spark keep one row per key inside each map task
    before the shuffle, so restated and hot keys do not pile up."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def staging(bronze: DataFrame, table: str, passed: DataFrame, columns: list[dict], key: str | None) -> DataFrame:
    """PASSED loads of a table, mapped, one row per key."""
    rows = mapped(gated(bronze, table, passed), columns)
    return latest_per_key(rows, key) if key else rows


def contract_differences(model: DataFrame, columns: list[dict]) -> list[tuple[str, str, str]]:
    """(column, expected, found) where a model's schema is not what its contract says."""
    found = {f.name: f.dataType.simpleString() for f in model.schema.fields if f.name not in SYSTEM}
    wanted = {c["alias"]: spark_cast_type(c["type"]) for c in columns}
    names = [n for n in wanted if found.get(n) != wanted[n]] + [n for n in found if n not in wanted]
    return [(n, wanted.get(n, "absent"), found.get(n, "absent")) for n in names]


def misfits(bronze: DataFrame, columns: list[dict]) -> DataFrame:
    """Per load and column: rows whose value the contract type cannot hold (an enforced cast would fail)."""
    checks = []
    for c in columns:
        source = F.expr(c["expr"]) if c.get("expr") else F.col(f"`{c['source']}`")
        lost = source.isNotNull() & source.try_cast(spark_cast_type(c["type"])).isNull()
        checks.append(F.count_if(lost).alias(c["alias"]))
    wide = bronze.groupBy(F.col("_load_id").alias("load_id")).agg(F.count(F.lit(1)).alias("row_count"), *checks)
    return wide.unpivot(["load_id", "row_count"], [c["alias"] for c in columns], "column_name", "misfits")
