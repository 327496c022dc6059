"""Blast radius: from drifted columns to staging models, downstream models and exposures."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.functions.ids import short_name
from loadwarden.policy import DEFAULT_EXPOSURE_TIER
from loadwarden.session import cut_lineage

KEYS = ["table_fqn", "load_id"]


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node reachable from a start over one or more edges.

    A frontier that shrinks by what is already known, so cycles end and a node found over many paths counts
    once. Each round is written to the checkpoint folder; nothing but an emptiness test reaches the driver.
    """
    step = edges.select("src", "dst").distinct()
    frontier = starts.select(F.col("node").alias("start"), "node").distinct()
    known = None
    while True:  # ends by itself: a round only keeps what no round has found before
        found = (frontier.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))
                 .distinct())
        if known is not None:
            found = found.join(known, ["start", "node"], "left_anti")
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return frontier if known is None else known
        known = frontier if known is None else known.unionByName(frontier)


def consumed_columns(events: DataFrame) -> DataFrame:
    """Names before and after of all events but additive ones: a new column has no reader yet."""
    return (events.where(F.col("drift_class") != "additive")
            .select(*KEYS, F.explode(F.array("column_before", "column_after")).alias("column"))
            .where(F.col("column").isNotNull()).select(*KEYS, F.upper("column").alias("column")).distinct())


def staging_readers(consumed: DataFrame, column_map: DataFrame, whole_words: bool = False) -> DataFrame:
    """Staging models whose map reads a consumed column, as a source or inside an expression."""
    maps = column_map.select(F.upper(short_name(F.col("table_fqn"))).alias("_table"), F.upper("table_fqn").alias("_full"), "model",
                             F.upper("source").alias("_source"), F.upper("expr").alias("_expr"))
    names = maps.groupBy("_table").agg(F.count_distinct("_full").alias("_names"))
    maps = maps.join(names, "_table")
    wanted = consumed.withColumn("_table", F.upper(short_name(F.col("table_fqn"))))
    # the last name segment stands for the table only where one mapped table ends in it
    same = (F.upper("table_fqn") == F.col("_full")) | (F.col("_names") == 1)
    if whole_words:
        words = F.array_contains(F.split("_expr", r"[^A-Z0-9_$]+"), F.col("column"))
    else:
        words = F.contains(F.col("_expr"), F.col("column"))
    reads = (F.col("_source") == F.col("column")) | F.coalesce(words, F.lit(False))
    return wanted.join(maps, "_table").where(same & reads).select(*KEYS, "model").distinct()


def blast_radius(events: DataFrame, column_map: DataFrame, nodes: DataFrame, edges: DataFrame, project: str,
                 rules: dict) -> DataFrame:
    """One row per load with events: columns, staging and downstream models, exposures, tier.

    The lists hold names of one lineage graph, not rows of a load.
    """
    consumed = consumed_columns(events)
    readers = staging_readers(consumed, column_map)
    node_of = F.concat(F.lit(f"model.{project}."), "model")
    starts = readers.select(node_of.alias("node")).distinct()
    closure = downstream(edges, starts)
    reached = (readers.select(*KEYS, node_of.alias("start")).join(closure, "start")
               .select(*KEYS, F.col("node").alias("id")).distinct())
    hit_models = (reached.where(F.col("id").startswith("model.")).groupBy(*KEYS)
                  .agg(F.array_sort(F.collect_list("id")).alias("_ids")))
    exposures = exposures_hit(reached, nodes)
    tier1 = F.col("tier") == 1
    by_load = exposures.groupBy(*KEYS).agg(
        F.max(tier1).alias("_tier1"), F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("id", "name", "label", "type", "owner", "tier", "audience"))).alias("exposures"))
    staging = readers.groupBy(*KEYS).agg(F.array_sort(F.collect_list("model")).alias("staging_models"))
    columns = consumed.groupBy(*KEYS).agg(F.array_sort(F.collect_list("column")).alias("columns"))
    names = F.array().cast("array<string>")
    joined = (events.select(*KEYS).distinct().join(columns, KEYS, "left").join(staging, KEYS, "left")
              .join(hit_models, KEYS, "left").join(by_load, KEYS, "left"))
    out = joined.select(
        *KEYS, F.coalesce("columns", names).alias("columns"), F.coalesce("staging_models", names).alias("staging_models"),
        F.coalesce(F.transform("_ids", short_name), names).alias("downstream_models"), "exposures",
        F.coalesce("_tier1", F.lit(False)).alias("_tier1"), F.coalesce("_n", F.lit(0)).alias("n_exposures"))
    models = F.size("downstream_models") + F.size("staging_models")
    tier = blast_tier(models, F.col("n_exposures"), F.col("_tier1"), rules)
    return out.select("*", tier.alias("tier")).drop("_tier1")


def blast_tier(n_models, n_exposures, any_tier1, rules: dict):
    high = (F.lit(rules["high_any_tier1"]) & any_tier1) | (n_models >= rules["high_min_models"])
    medium = (n_exposures >= rules["medium_min_exposures"]) | (n_models >= rules["medium_min_models"])
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def exposures_hit(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exposures among the reached nodes, with label, owner, tier and audience."""
    known = nodes.where(F.col("kind") == "exposure").select(
        "id", "name", F.coalesce("label", "name").alias("label"), "type", "owner",
        F.coalesce("tier", F.lit(DEFAULT_EXPOSURE_TIER)).alias("tier"), "audience")
    return reached.where(F.col("id").startswith("exposure.")).join(known, "id")


def affected_models(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Models to rebuild: the changed ones and all models downstream of them."""
    reached = downstream(edges, changed).select("node").unionByName(changed.select("node"))
    return reached.where(F.col("node").startswith("model.")).select(short_name(F.col("node")).alias("model")).distinct()
