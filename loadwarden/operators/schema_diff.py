"""Schema differences of many (table, load) pairs in one join."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.functions.types import compare_types
from loadwarden.policy import SYSTEM_COLUMNS

KEYS = ["table_fqn", "load_id"]


def _side(snapshots: DataFrame, pairs: DataFrame, id_col: str, suffix: str) -> DataFrame:
    wanted = pairs.select(*KEYS, F.col(id_col).alias("snapshot_id")) if id_col != "load_id" else pairs.select(
        *KEYS, F.col("load_id").alias("snapshot_id"))
    return (snapshots.where(~F.upper("column_name").isin(*SYSTEM_COLUMNS))
            .join(wanted, ["table_fqn", "snapshot_id"])
            .select(*KEYS, F.upper("column_name").alias("_name"), F.col("column_name").alias(f"column_{suffix}"),
                    F.col("data_type").alias(f"type_{suffix}"), F.col("ordinal_position").alias(f"ordinal_{suffix}"),
                    F.col("is_nullable").alias(f"nullable_{suffix}"), F.col("parsed").alias(f"parsed_{suffix}"),
                    F.col("family").alias(f"family_{suffix}")))


def schema_diff(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per column of (table_fqn, load_id, before_id): change = added | dropped | type_changed | unchanged.

    System columns never count. Types are compared after parsing, so spelling alone is no change.
    """
    before, after = _side(snapshots, pairs, "before_id", "before"), _side(snapshots, pairs, "load_id", "after")
    both = before.join(after, [*KEYS, "_name"], "full_outer").drop("_name")
    old, new = F.col("parsed_before"), F.col("parsed_after")
    change = (F.when(F.col("column_before").isNull(), "added").when(F.col("column_after").isNull(), "dropped")
              .when(old != new, "type_changed").otherwise("unchanged"))
    return both.select(
        "*", change.alias("change"),
        F.coalesce("family_after", "family_before").alias("family"),
        F.when(change == "type_changed", compare_types(old, new)).alias("type_relation"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Per load: the changed names as sorted text lists."""
    def names(kind: str, text) -> F.Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == kind, text))), ",").alias(kind)

    arrow = F.concat("column_before", F.lit(":"), "type_before", F.lit("→"), "type_after")
    return diff.groupBy(*KEYS).agg(names("added", F.col("column_after")), names("dropped", F.col("column_before")),
                                   names("type_changed", arrow),
                                   F.count_if(F.col("change") == "unchanged").alias("unchanged_columns"))
