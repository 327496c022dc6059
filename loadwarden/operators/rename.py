"""Rename detection: value containment of dropped and added columns, fingerprint scores, one-to-one matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions.stats import fingerprint
from loadwarden.functions.types import compare_types

KEYS = ["table_fqn", "load_id"]
PAIR = [*KEYS, "column_before", "column_after"]
#: Rounds in which pairs that are the best of both their columns are taken before the rest is folded.
ROUNDS = 2


def exact_containment(diff: DataFrame, baseline_loads: DataFrame, counts: DataFrame) -> DataFrame:
    """Share of an added column's distinct values that a dropped column of the same family had in its baseline.

    Columns meet only through a value they share (an equi join on the value), never as all pairs of a table:
    a pair that shares nothing is absent, and its containment is 0. Values meet first and learn then, from schema rows, which
    candidate compares the two columns: so each old value moves once, however many candidates have its load in their baseline.
    """
    dropped = diff.where(F.col("change") == "dropped").select(*KEYS, "column_before", "family")
    added = diff.where(F.col("change") == "added").select(*KEYS, "column_after", "family")
    values = counts.where(F.col("value").isNotNull()).select("table_fqn", "load_id", "column_name", "value")
    compared = (dropped.join(baseline_loads.select(*KEYS, "base_load_id"), KEYS)
                .withColumn("_column", F.upper("column_before")))
    held = ["table_fqn", "base_load_id", "_column"]
    old = (values.withColumnsRenamed({"load_id": "base_load_id", "column_name": "_column"})
           .join(compared.select(*held, "family").distinct(), held))
    new = (added.withColumn("_column", F.upper("column_after"))
           .join(values.withColumnRenamed("column_name", "_column"), [*KEYS, "_column"])
           .select(*KEYS, "family", "column_after", "value"))
    met = (old.join(new, ["table_fqn", "family", "value"]).join(compared, [*KEYS, "base_load_id", "_column", "family"])
           .select(*PAIR, "family", "value").distinct())
    shared = met.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_shared"))
    sizes = new.groupBy(*KEYS, "column_after").agg(F.count(F.lit(1)).alias("_new"))
    return shared.join(sizes, [*KEYS, "column_after"]).select(*PAIR, (F.col("_shared") / F.col("_new")).alias("containment"))


def last_profiles(profiles: DataFrame, baseline_loads: DataFrame) -> DataFrame:
    """Newest baseline profile of each column, per candidate load: the statistics below that `profiles` has."""
    kept = [c for c in ("null_rate", "distinct_count", "top_k") if c in profiles.columns]
    base = profiles.select("table_fqn", F.col("load_id").alias("base_load_id"), "column_name", F.struct(*kept).alias("_p"))
    return (baseline_loads.join(base, ["table_fqn", "base_load_id"])
            .groupBy(*KEYS, "column_name").agg(F.max_by("_p", "base_load_id").alias("_p"))
            .select(*KEYS, "column_name", *[F.col(f"_p.{c}").alias(c) for c in kept]))


def scored_pairs(diff: DataFrame, profiles: DataFrame, baseline_loads: DataFrame, containment: DataFrame,
                 thresholds: dict) -> DataFrame:
    """Every dropped column beside every added one of the same load, with its score or the reason it has none.

    The pairing is part of the result (each leftover column must say why it is no rename) and lives on schema
    rows only: its size is bounded by the width of one table, whatever the size of the load.
    """
    old = last_profiles(profiles, baseline_loads).select(
        *KEYS, F.col("column_name").alias("_old"), F.col("null_rate").alias("null_old"),
        F.col("distinct_count").alias("distinct_old"))
    new = profiles.select(*KEYS, F.col("column_name").alias("_new"), F.col("null_rate").alias("null_new"),
                          F.col("distinct_count").alias("distinct_new"))
    dropped = (diff.where(F.col("change") == "dropped").select(
        *KEYS, "column_before", "type_before", "family_before", "parsed_before")
               .withColumn("_old", F.upper("column_before")).join(old, [*KEYS, "_old"], "left"))
    added = (diff.where(F.col("change") == "added").select(
        *KEYS, "column_after", "type_after", "family_after", "parsed_after", "ordinal_after")
             .withColumn("_new", F.upper("column_after")).join(new, [*KEYS, "_new"], "left"))
    pairs = dropped.join(added, KEYS).join(containment, PAIR, "left")
    fp = fingerprint(F.coalesce("containment", F.lit(0.0)), F.col("null_old"), F.col("null_new"),
                     F.col("distinct_old"), F.col("distinct_new"), thresholds["rename_weights"])
    least = thresholds["rename_min_distinct"]
    other_family = F.col("family_before") != F.col("family_after")
    unprofiled = F.col("distinct_old").isNull() | F.col("distinct_new").isNull()
    too_small = F.least("distinct_old", "distinct_new") < least
    scored = pairs.withColumn("fp", F.when(~other_family & ~unprofiled & ~too_small, fp))
    low = F.col("fp.score") < thresholds["rename_min_score"]
    reason = (
        F.when(other_family, F.concat(F.lit("type family "), "type_before", F.lit(" vs "), "type_after"))
        .when(unprofiled, "missing profile")
        .when(too_small, f"distinct values below {least}; too small to fingerprint")
        .when(low, F.concat(F.lit("score "), F.col("fp.score").cast("string"),
                            F.lit(f" < {thresholds['rename_min_score']}"))))
    relation = compare_types(F.col("parsed_before"), F.col("parsed_after"))
    return scored.select(*PAIR, "type_before", "type_after", "ordinal_after", relation.alias("type_relation"), "fp.score", "fp.value_containment", "fp.null_similarity",
                         "fp.distinct_ratio", reason.alias("reason"))


def _settled(pairs: DataFrame) -> DataFrame:
    """One round over pairs with `_order` and `_taken` (null: open): an open pair that comes first among the open ones of both its columns is taken, which the
    whole order would do too, and the other open pairs of these columns are not. Windows by column, so no load meets in one task."""
    by_old, by_new = Window.partitionBy(*KEYS, "column_before"), Window.partitionBy(*KEYS, "column_after")
    open_order = F.when(F.col("_taken").isNull(), F.col("_order"))
    first = (pairs.withColumn("_first_old", F.min(open_order).over(by_old)).withColumn("_first_new", F.min(open_order).over(by_new))
             .withColumn("_now", F.col("_taken").isNull() & (F.col("_order") == F.col("_first_old")) & (F.col("_order") == F.col("_first_new"))))
    met = first.withColumn("_met", F.max("_now").over(by_new)).withColumn("_met", F.col("_met") | F.max("_now").over(by_old))
    taken = F.when(F.col("_now"), True).when(F.col("_taken").isNull() & F.col("_met"), False).otherwise(F.col("_taken"))
    return met.withColumn("_taken", taken).drop("_first_old", "_first_new", "_now", "_met")


def rename_pairs(scored: DataFrame) -> DataFrame:
    """One-to-one matching of accepted pairs: best score first, then names, each column used once.

    Pairs that are the best of both their columns are settled in rounds over the columns; only what ROUNDS rounds leave open (chains of
    pairs that wait for one another, as equal scores give) is folded in order, one array per load. The result is that of the whole order.
    """
    fields = ["column_before", "column_after", "type_before", "type_after", "type_relation", "score", "value_containment", "null_similarity", "distinct_ratio"]
    pairs = scored.where(F.col("reason").isNull()).select(
        *KEYS, *fields, F.struct((-F.col("score")).alias("neg"), "column_before", "column_after").alias("_order"), F.lit(None).cast("boolean").alias("_taken"))
    for _ in range(ROUNDS):
        pairs = _settled(pairs)
    settled = pairs.where("_taken").select(*KEYS, *fields)
    entry = F.struct(F.col("_order.neg").alias("neg"), *fields)
    lists = pairs.where(F.col("_taken").isNull()).groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    empty = F.expr("filter(c, x -> false)")

    def used(acc: Column, name: str, value: Column) -> Column:
        return F.exists(acc, lambda t: t[name] == value)

    def step(acc: Column, x: Column) -> Column:
        taken = used(acc, "column_before", x["column_before"]) | used(acc, "column_after", x["column_after"])
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    return settled.unionByName(lists.select(*KEYS, F.inline(F.aggregate("c", empty, step))).drop("neg"))
