"""The source contract as intervals of loads: what each load was promised to hold, now and at any load before."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions.types import contract_type, parse_type
from loadwarden.operators.staging import SYSTEM

COLUMN = ["table_fqn", "column_name"]


def contract_versions(contract: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """table_fqn, column_name, data_type, valid_from, valid_to (exclusive; null while it holds).

    A new column opens an interval, a widening closes one and opens the next with the wider type, a rename closes the old column and opens
    the new one, a lost column is closed. What the contract says already changes nothing. The first interval starts at the empty load id.
    Without events the contract holds for all loads.
    """
    first = contract.select("table_fqn", F.upper("column_name").alias("column_name"), F.lit("").alias("valid_from"), F.lower("data_type").alias("data_type"))
    facts = first if events is None else first.unionByName(_turns(events))
    # of one load, an opening outweighs a closing of the same name
    facts = facts.groupBy(*COLUMN, "valid_from").agg(F.max("data_type").alias("data_type"))
    by_load = Window.partitionBy(*COLUMN).orderBy("valid_from")
    turns = facts.withColumn("_before", F.lag("data_type").over(by_load)).where(~F.col("data_type").eqNullSafe(F.col("_before")))
    return (turns.withColumn("valid_to", F.lead("valid_from").over(by_load)).where(F.col("data_type").isNotNull())
            .select(*COLUMN, "data_type", "valid_from", "valid_to"))


def _turns(events: DataFrame) -> DataFrame:
    """The openings and closings (no type) that the events make."""
    typed = contract_type(parse_type(F.col("type_after")))
    names = lambda c: F.upper(c).alias("column_name")
    opened = events.where(F.col("drift_class").isin("additive", "rename", "type_widening")).select(
        "table_fqn", names("column_after"), F.col("load_id").alias("valid_from"), typed.alias("data_type"))
    closed = events.where((F.col("drift_class") == "rename") | (F.col("subtype") == "column_dropped")).select(
        "table_fqn", names("column_before"), F.col("load_id").alias("valid_from"), F.lit(None).cast("string").alias("data_type"))
    return opened.unionByName(closed)


def contract_as_of(loads: DataFrame, versions: DataFrame) -> DataFrame:
    """The contract in force at each load of (table_fqn, load_id): an as-of join by table and load. One row per load and column."""
    v, at = versions.withColumnRenamed("table_fqn", "_table"), F.col("load_id")
    holds = (F.col("table_fqn") == F.col("_table")) & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return loads.select("table_fqn", "load_id").distinct().join(v, holds).select(
        "table_fqn", "load_id", "column_name", "data_type", F.col("valid_from").alias("since"))


def contract_gaps(snapshots: DataFrame, promised: DataFrame) -> DataFrame:
    """table_fqn, load_id, column_name, expected, found where a load's schema is not what `promised` (from `contract_as_of`) says; the columns
    that loading adds are no part of a contract."""
    carried = snapshots.where(~F.lower("column_name").isin(*SYSTEM)).select(
        "table_fqn", F.col("snapshot_id").alias("load_id"), F.upper("column_name").alias("column_name"), contract_type(parse_type(F.col("data_type"))).alias("_found"))
    wanted = promised.select("table_fqn", "load_id", "column_name", contract_type(parse_type(F.col("data_type"))).alias("_expected"))
    return (wanted.join(carried, ["table_fqn", "load_id", "column_name"], "full").where(~F.col("_expected").eqNullSafe(F.col("_found")))
            .select("table_fqn", "load_id", "column_name", F.coalesce("_expected", F.lit("absent")).alias("expected"), F.coalesce("_found", F.lit("absent")).alias("found")))


def rewritten_contract(contract: DataFrame, versions: DataFrame) -> DataFrame:
    """The contract as it reads after all changes: texts and meta of known columns are kept, new ones say since when they are there."""
    now = versions.where("valid_to IS NULL").select("table_fqn", F.col("column_name").alias("_c"), "data_type", "valid_from")
    old = contract.select("table_fqn", F.upper("column_name").alias("_c"), F.col("column_name").alias("_name"), "description", "meta")
    return now.join(old, ["table_fqn", "_c"], "left").select(
        "table_fqn", F.coalesce("_name", "_c").alias("column_name"), "data_type",
        F.coalesce("description", F.when(F.col("_name").isNull(), F.concat(F.lit("Since load "), "valid_from"))).alias("description"), "meta")
