"""Drift events of all new loads: structural changes, renames and changes of meaning in one table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.functions.ids import event_id
from loadwarden.functions.stats import semantic_confidence
from loadwarden.operators.rename import rename_pairs
from loadwarden.operators.semantic import categorical_checks, category_shares, numeric_checks

KEYS = ["table_fqn", "load_id"]
#: Events whose evidence asks whether the rows were sent before.
RESCALED = "subtype IN ('unit_change', 'scale_shift')"
FIELDS = [*KEYS, "drift_class", "subtype", "column_before", "column_after", "type_before", "type_after", "confidence"]
EVIDENCE = ["score", "value_containment", "null_similarity", "distinct_ratio", "type_relation",
            "possible_replacements", "nullable", "check", "baseline_median", "new_median", "ratio_baseline_over_new",
            "robust_z", "baseline_loads", "hypothesis", "restatement_check", "psi", "domain_overlap",
            "baseline_distribution", "new_distribution"]


def _structural(diff: DataFrame, scored: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    text = lambda v: F.lit(v)
    one = F.lit(1.0)
    renames = pairs.select(
        *KEYS, text("rename").alias("drift_class"), text("column_renamed").alias("subtype"), "column_before",
        "column_after", "type_before", "type_after", F.col("score").alias("confidence"), "score", "value_containment",
        "null_similarity", "distinct_ratio", "type_relation")
    unpaired_added = diff.where(F.col("change") == "added").join(
        pairs.select(*KEYS, "column_after"), [*KEYS, "column_after"], "left_anti")
    unpaired_dropped = diff.where(F.col("change") == "dropped").join(
        pairs.select(*KEYS, "column_before"), [*KEYS, "column_before"], "left_anti")
    # a candidate that lost to a better pair carries no reason of its own
    leftovers = (scored.join(unpaired_added.select(*KEYS, "column_after"), [*KEYS, "column_after"], "left_semi")
                 .groupBy(*KEYS, "column_before")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     F.col("ordinal_after").alias("ordinal"), F.col("column_after").alias("column"),
                     F.col("type_after").alias("type"),
                     F.coalesce("reason", F.lit("no match")).alias("why_not_rename")))).alias("_left")))
    replacements = F.transform("_left", lambda x: F.struct(x["column"].alias("column"), x["type"].alias("type"),
                                                           x["why_not_rename"].alias("why_not_rename")))
    dropped = unpaired_dropped.join(leftovers, [*KEYS, "column_before"], "left").select(
        *KEYS, text("breaking").alias("drift_class"), text("column_dropped").alias("subtype"), "column_before",
        F.lit(None).cast("string").alias("column_after"), "type_before", F.lit(None).cast("string").alias("type_after"),
        one.alias("confidence"), replacements.alias("possible_replacements"))
    added = unpaired_added.select(
        *KEYS, text("additive").alias("drift_class"), text("column_added").alias("subtype"),
        F.lit(None).cast("string").alias("column_before"), "column_after", F.lit(None).cast("string").alias("type_before"),
        "type_after", one.alias("confidence"), F.col("nullable_after").alias("nullable"))
    wide = F.col("type_relation").isin("widening", "widening_lossy")
    retyped = diff.where(F.col("change") == "type_changed").select(
        *KEYS, F.when(wide, "type_widening").otherwise("breaking").alias("drift_class"),
        F.when(F.col("type_relation") == "widening", "lossless_widening")
        .when(F.col("type_relation") == "widening_lossy", "lossy_widening")
        .when(F.col("type_relation") == "narrowing", "type_narrowing").otherwise("type_incompatible").alias("subtype"),
        "column_before", "column_after", "type_before", "type_after", one.alias("confidence"), "type_relation")
    return [renames, dropped, added, retyped]


def _named() -> list:
    return [F.col("column_name").alias("column_before"), F.col("column_name").alias("column_after"),
            F.col("data_type").alias("type_before"), F.col("data_type").alias("type_after")]


def _rescaled(numeric: DataFrame, restated: DataFrame | None) -> DataFrame:
    column = [*KEYS, "column_name"]
    found = numeric.where("flagged")
    if restated is None:
        found = found.withColumn("restatement_check", F.lit(None).cast(
            "struct<matched_rows: bigint, ratio_median: double, ratio_cv: double>"))
    else:
        found = found.join(restated.select(*column, F.struct("matched_rows", "ratio_median", "ratio_cv")
                                           .alias("restatement_check")), column, "left")
    has_factor = F.col("hypothesis").isNotNull()
    subtype = F.when(has_factor, "unit_change").otherwise("scale_shift")
    return found.select(
        *KEYS, F.lit("semantic").alias("drift_class"), subtype.alias("subtype"), *_named(),
        semantic_confidence(F.lit(False), subtype, has_factor, F.col("restatement_check.matched_rows"),
                            F.col("restatement_check.ratio_cv")).alias("confidence"),
        F.lit("numeric_scale_shift").alias("check"), "baseline_median", "new_median", "ratio_baseline_over_new",
        "robust_z", "baseline_loads", "hypothesis", "restatement_check")


def _recoded(categorical: DataFrame) -> DataFrame:
    return categorical.where("flagged").select(
        *KEYS, F.lit("semantic").alias("drift_class"), "subtype", *_named(),
        semantic_confidence(F.lit(True), F.col("subtype"), F.lit(False), F.lit(0), F.lit(1.0)).alias("confidence"),
        F.lit("categorical_shift").alias("check"), "psi", "domain_overlap", "baseline_distribution", "new_distribution")


def _events(parts: list[DataFrame]) -> DataFrame:
    """The parts as one table of events. The evidence struct has the fields that some part carries."""
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ident = event_id(*[F.col(c) for c in FIELDS[:6]])
    return events.select(ident.alias("event_id"), *FIELDS, F.struct(*[c for c in EVIDENCE if c in events.columns]).alias("evidence"))


def structural_events(diff: DataFrame, scored: DataFrame) -> DataFrame:
    """The events of `classify` that schemas and renames give: all that a contract or a recoding rests on."""
    return _events(_structural(diff, scored, rename_pairs(scored)))


def rescaled_events(numeric: DataFrame) -> DataFrame:
    """The events of `classify` that the output of `numeric_checks` gives, without restatement evidence."""
    return _events([_rescaled(numeric, None)])


def classify(diff: DataFrame, scored: DataFrame, profiles: DataFrame, baseline_loads: DataFrame, thresholds: dict,
             key_columns: DataFrame | None = None, restated: DataFrame | None = None) -> DataFrame:
    """Events of every (table, load) in `diff`: FIELDS, an evidence struct and the event id.

    `scored` is the output of `scored_pairs`; `restated` that of `restatement`, unioned over columns.
    """
    pairs = rename_pairs(scored)
    numeric = numeric_checks(diff, profiles, baseline_loads, thresholds, key_columns)
    categorical = categorical_checks(category_shares(diff, profiles, baseline_loads, thresholds, key_columns), thresholds)
    return _events([*_structural(diff, scored, pairs), _rescaled(numeric, restated), _recoded(categorical)])


def with_restatement(events: DataFrame, restated: DataFrame) -> DataFrame:
    """The events with restatement evidence put in where there is some, and the confidence that follows from it."""
    check = F.struct("matched_rows", "ratio_median", "ratio_cv")
    found = restated.select(*KEYS, F.col("column_name").alias("column_before"), check.alias("_check"), F.lit("numeric_scale_shift").alias("_kind"))
    joined = events.withColumn("_kind", F.col("evidence.check")).join(found, [*KEYS, "column_before", "_kind"], "left")
    surer = semantic_confidence(F.lit(False), F.col("subtype"), F.col("evidence.hypothesis").isNotNull(), F.col("_check.matched_rows"), F.col("_check.ratio_cv"))
    has = F.col("_check").isNotNull()
    return joined.withColumns({"confidence": F.when(has, surer).otherwise(F.col("confidence")),
                               "evidence": F.when(has, F.col("evidence").withField("restatement_check", F.col("_check"))).otherwise(F.col("evidence"))}
                              ).select(*events.columns)


def event_order() -> list:
    """The stable order of events inside a load."""
    return [F.col("drift_class"), F.coalesce("column_before", F.lit("")), F.coalesce("column_after", F.lit(""))]
