"""Change of meaning under an unchanged name and type: scale shifts of numbers, share shifts of codes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions.stats import array_median, match_factor, psi_term, robust_z
from loadwarden.operators.quantiles import exact_quantiles, with_quantiles
from loadwarden.session import write_through

KEYS = ["table_fqn", "load_id"]
COLUMN = [*KEYS, "column_name"]


def checked_columns(diff: DataFrame, families: tuple[str, ...], key_columns: DataFrame | None) -> DataFrame:
    """Unchanged columns of the given families, keys left out (keys grow, their medians move)."""
    cols = diff.where((F.col("change") == "unchanged") & F.col("family").isin(*families)).select(
        *KEYS, F.upper("column_before").alias("column_name"), F.col("type_after").alias("data_type"), "family")
    if key_columns is None:
        return cols
    keys = key_columns.select("table_fqn", F.upper("key_column").alias("column_name"))
    return cols.join(keys, ["table_fqn", "column_name"], "left_anti")


def numeric_checks(diff: DataFrame, profiles: DataFrame, baseline_loads: DataFrame, thresholds: dict,
                   key_columns: DataFrame | None = None) -> DataFrame:
    """Factor, robust z and unit hypothesis of every testable numeric column, with the verdict `flagged`.

    The baseline arrays hold one median per baseline load, seven at most.
    """
    cols = checked_columns(diff, ("numeric",), key_columns)
    base = profiles.select("table_fqn", F.col("load_id").alias("base_load_id"), "column_name",
                           F.col("num_median").alias("_median"))
    usable = F.when(F.col("_median") != 0, F.col("_median"))
    history = (cols.join(baseline_loads, KEYS).join(base, ["table_fqn", "base_load_id", "column_name"])
               .groupBy(*COLUMN).agg(F.collect_list(usable).alias("_medians"),
                                     F.array_sort(F.collect_list("base_load_id")).alias("baseline_loads")))
    new = profiles.select(*COLUMN, F.col("num_median").alias("_new"))
    rows = (cols.join(history, COLUMN).join(new, COLUMN)
            .where((F.size("_medians") >= thresholds["semantic_min_loads"]) & (F.col("_new") != 0)))
    base_med = array_median(F.array_sort("_medians"))
    ratio = base_med / F.col("_new")
    # medians on both sides of zero may have the median zero: such a column has no scale, so no factor and no flag
    rows = rows.select("*", base_med.alias("_base"), ratio.alias("_ratio"),
                       F.when(ratio != 0, F.greatest(ratio, F.try_divide(F.lit(1.0), ratio))).alias("_factor"),
                       robust_z(F.col("_new"), F.col("_medians")).alias("_z"))
    flagged = F.coalesce((F.col("_factor") >= thresholds["semantic_min_factor"])
                         & (F.col("_z") >= thresholds["semantic_min_robust_z"]), F.lit(False))
    hypothesis = match_factor(F.col("_ratio"), thresholds["known_factors"])
    return rows.select(
        *COLUMN, "data_type", F.round("_base", 4).alias("baseline_median"), F.round("_new", 4).alias("new_median"),
        F.round("_ratio", 4).alias("ratio_baseline_over_new"), F.round("_factor", 4).alias("factor"),
        F.round("_z", 1).alias("robust_z"), "baseline_loads", F.when(flagged, hypothesis).alias("hypothesis"),
        flagged.alias("flagged"))


def restatement(new_rows: DataFrame, passed_rows: DataFrame, table: str, key: str, column: str) -> DataFrame:
    """Per new load: rows re-sent under a known key, median of old / new and its coefficient of variation.

    The old side is reduced to the latest row per key before the join; the ranking is cut inside each map task,
    so a key sent very often does not travel whole.
    """
    order = Window.partitionBy("_k").orderBy(F.desc("_at"), F.desc("_load"))
    wanted = new_rows.select(F.col(key).alias("_k")).distinct()
    old = (passed_rows.select(F.col(key).alias("_k"), F.col(column).cast("double").alias("_old"),
                              F.col("_loaded_at").alias("_at"), F.col("_load_id").alias("_load"))
           .join(wanted, "_k", "left_semi")
           .withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("_k", "_old"))
    new = new_rows.select(F.lit(table).alias("table_fqn"), F.col("_load_id").alias("load_id"), F.col(key).alias("_k"),
                          F.col(column).cast("double").alias("_new"))
    # the re-sent rows alone, written once: three aggregates read them, and none replays the join
    pairs = write_through(new.join(old, "_k").select(*KEYS, F.try_divide("_old", "_new").alias("_ratio")), "resent-rows")
    stats = pairs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("matched_rows"),
        F.coalesce(F.stddev("_ratio") / F.nullif(F.avg("_ratio"), F.lit(0.0)), F.lit(0.0)).alias("ratio_cv"))
    median = exact_quantiles(pairs, KEYS, "_ratio", {"ratio_median": 0.5})
    return with_quantiles(stats, median, KEYS).select(
        *KEYS, F.lit(column.upper()).alias("column_name"), "matched_rows",
        F.coalesce("ratio_median", F.lit(0.0)).alias("ratio_median"), "ratio_cv")


def category_shares(diff: DataFrame, profiles: DataFrame, baseline_loads: DataFrame, thresholds: dict,
                    key_columns: DataFrame | None = None) -> DataFrame:
    """Expected (baseline mean, absent counts 0) and new share of every value of every testable code column."""
    cols = checked_columns(diff, ("text", "boolean"), key_columns)
    filled = profiles.where(F.size("top_k") > 0).select("table_fqn", "load_id", "column_name", "top_k")
    base = (cols.join(baseline_loads, KEYS)
            .join(filled.withColumnRenamed("load_id", "base_load_id"), ["table_fqn", "base_load_id", "column_name"]))
    loads = (base.groupBy(*COLUMN).agg(F.countDistinct("base_load_id").alias("_loads"))
             .where(F.col("_loads") >= thresholds["semantic_min_loads"]))
    new = cols.join(filled, COLUMN).select(*COLUMN, "data_type", F.explode("top_k").alias("value", "share"))
    testable = loads.join(new.select(*COLUMN, "data_type").distinct(), COLUMN)
    shares = base.select(*COLUMN, F.explode("top_k").alias("value", "_base"), F.lit(None).cast("double").alias("_new"))
    shares = shares.unionByName(new.select(*COLUMN, "value", F.lit(None).cast("double").alias("_base"),
                                           F.col("share").alias("_new")))
    merged = shares.groupBy(*COLUMN, "value").agg(F.sum("_base").alias("_base"), F.max("_new").alias("actual"))
    return merged.join(testable, COLUMN).select(*COLUMN, "data_type", "value",
                                                (F.col("_base") / F.col("_loads")).alias("expected"), "actual")


def categorical_checks(shares: DataFrame, thresholds: dict) -> DataFrame:
    """Population stability index and domain overlap per code column, with the verdict `flagged`."""
    both = F.col("expected").isNotNull() & F.col("actual").isNotNull()
    dist = lambda c: F.map_from_entries(F.collect_list(  # noqa: E731 - at most top-k values per load
        F.when(F.col(c).isNotNull(), F.struct("value", F.round(c, 3)))))
    rows = shares.groupBy(*COLUMN, "data_type").agg(
        F.sum(psi_term(F.col("expected"), F.col("actual"))).alias("_psi"),
        (F.count_if(both) / F.count(F.lit(1))).alias("_overlap"),
        dist("expected").alias("baseline_distribution"), dist("actual").alias("new_distribution"))
    flagged = F.col("_psi") >= thresholds["categorical_psi"]
    subtype = F.when(F.col("_overlap") >= thresholds["categorical_domain_overlap"], "code_meaning_change"
                     ).otherwise("new_value_domain")
    return rows.select(*COLUMN, "data_type", F.round("_psi", 3).alias("psi"), F.round("_overlap", 3).alias("domain_overlap"),
                       "baseline_distribution", "new_distribution", flagged.alias("flagged"),
                       F.when(flagged, subtype).alias("subtype"))
