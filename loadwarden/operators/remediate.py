"""Fixes proposed for drifted loads, as changes of the source contract and the column maps."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions.ids import short_name
from loadwarden.functions.types import contract_type, parse_type

KEYS = ["table_fqn", "load_id"]
# Multiplier that leads values back to the contract unit, by detected factor and direction.
NORMALISERS = {(84.0, "down"): 84.0}


def _table(c: str = "table_fqn"):
    return F.upper(short_name(F.col(c)))


def _typed(c: str):
    return contract_type(parse_type(F.col(c)))


def document_columns(contract: DataFrame, events: DataFrame) -> DataFrame:
    """Contract rows for added columns that it does not list yet."""
    added = events.where(F.col("drift_class") == "additive").select(
        "table_fqn", F.col("column_after").alias("column_name"), _typed("type_after").alias("data_type"),
        F.concat(F.lit("Added by producer in load "), "load_id", F.lit("; not yet consumed")).alias("description"),
        F.create_map(F.lit("state"), F.lit("new_unused")).alias("meta"), _table().alias("_t"),
        F.upper("column_after").alias("_c"))
    known = contract.select(_table().alias("_t"), F.upper("column_name").alias("_c"))
    return added.join(known, ["_t", "_c"], "left_anti").drop("_t", "_c")


def widen_map_types(column_map: DataFrame, events: DataFrame) -> DataFrame:
    """Map rows whose type follows a widening, old and new."""
    wider = events.where(F.col("drift_class") == "type_widening").select(
        "load_id", _table().alias("_t"), F.upper("column_before").alias("_c"), _typed("type_after").alias("new_type"))
    return (column_map.withColumns({"_t": _table(), "_c": F.upper("source")}).join(wider, ["_t", "_c"])
            .where(F.lower("type") != F.col("new_type"))
            .select("load_id", "model", "alias", F.col("type").alias("old_type"), "new_type"))


def remap_sources(column_map: DataFrame, events: DataFrame, load_id: str) -> DataFrame:
    """The whole column map as it reads after the renames of one load; aliases never change."""
    renamed = events.where((F.col("drift_class") == "rename") & (F.col("load_id") == load_id)).select(
        _table().alias("_t"), F.upper("column_before").alias("_c"), F.col("column_after").alias("_new"))
    rows = column_map.withColumns({"_t": _table(), "_c": F.upper("source")}).join(renamed, ["_t", "_c"], "left")
    return rows.withColumn("source", F.coalesce("_new", "source")).select(*column_map.columns)


def recode_pairs(events: DataFrame, old_profiles: DataFrame, new_profiles: DataFrame) -> DataFrame:
    """For each dropped column: the first added column with as many values, and value pairs by rank of share.

    Ranking covers the top-k values of a profile only.
    """
    def ranked(profiles: DataFrame, column: str, value: str) -> DataFrame:
        order = Window.partitionBy(*KEYS, column).orderBy(F.desc("_share"), value)
        size = F.size("top_k").alias("_size")
        return (profiles.where(F.size("top_k") > 0)
                .select(*KEYS, F.col("column_name").alias(column), size, F.explode("top_k").alias(value, "_share"))
                .withColumn("rank", F.row_number().over(order)).drop("_share"))

    dropped = events.where(F.col("subtype") == "column_dropped").select(*KEYS, F.upper("column_before").alias("column_before"))
    added = events.where(F.col("drift_class") == "additive").select(
        *KEYS, F.upper("column_after").alias("column_after"), "type_after")
    old = ranked(old_profiles, "column_before", "old_value").join(dropped, [*KEYS, "column_before"], "left_semi")
    new = ranked(new_profiles, "column_after", "new_value").join(added, [*KEYS, "column_after"])
    pairs = old.join(new, [*KEYS, "_size", "rank"])
    first = Window.partitionBy(*KEYS, "column_before").orderBy("column_after")
    return (pairs.withColumn("_pick", F.dense_rank().over(first)).where("_pick = 1")
            .select(*KEYS, "column_before", "column_after", "type_after", "rank", "new_value", "old_value"))


def recode_expressions(pairs: DataFrame) -> DataFrame:
    """One `case` expression per replaced column; a boolean source is tested as it stands or negated."""
    boolean = parse_type(F.col("type_after"))["base"] == "BOOLEAN"
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    test = F.when(boolean, F.concat(F.when(F.lower("new_value") == "true", "").otherwise("not "), "column_after")
                  ).otherwise(F.concat("column_after", F.lit(" = "), quoted("new_value")))
    when = F.concat(F.lit("when "), test, F.lit(" then "), quoted("old_value"))
    return pairs.groupBy(*KEYS, "column_before", "column_after").agg(
        F.concat(F.lit("case "), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", when.alias("w")))), lambda x: x["w"]), " "), F.lit(" end"))
        .alias("expr"))


def normalise_units(column_map: DataFrame, events: DataFrame, confirmed: bool,
                    normalisers: dict[tuple[float, str], float] = NORMALISERS) -> DataFrame:
    """Expressions that lead loads from the drifted one on back to the contract unit, once it is confirmed."""
    found = events.where((F.col("subtype") == "unit_change") & F.lit(confirmed))
    h = F.col("evidence.hypothesis")
    times = F.coalesce(*[F.when((h["factor"] == f) & (h["direction"] == d), F.lit(m))
                         for (f, d), m in normalisers.items()])
    fixes = found.select(*KEYS, _table().alias("_t"), F.upper("column_before").alias("_c"), times.alias("_times"))
    rows = column_map.withColumns({"_t": _table(), "_c": F.upper("source")}).drop("table_fqn").join(fixes, ["_t", "_c"])
    source = F.col("source")
    return rows.where(F.col("_times").isNotNull()).select(
        *KEYS, "model", "alias", F.concat(
            F.lit("case when _load_id >= '"), "load_id", F.lit("' then "), source, F.lit(" * "),
            F.col("_times").cast("string"), F.lit(" else "), source, F.lit(" end")).alias("expr"))


def with_expressions(column_map: DataFrame, expressions: DataFrame) -> DataFrame:
    """Column map with the sources of the given (model, alias) rows replaced by expressions."""
    new = expressions.select("model", "alias", F.col("expr").alias("_expr"))
    rows = column_map.join(new, ["model", "alias"], "left")
    return rows.withColumns({
        "source": F.when(F.col("_expr").isNull(), F.col("source")), "expr": F.coalesce("_expr", "expr"),
    }).select(*column_map.columns)


def recoded_aliases(column_map: DataFrame, expressions: DataFrame) -> DataFrame:
    """(model, alias, expr) for every map row that reads a replaced column."""
    new = expressions.select(_table().alias("_t"), F.upper("column_before").alias("_c"), F.col("expr").alias("_new"))
    return (column_map.withColumns({"_t": _table(), "_c": F.upper("source")}).join(new, ["_t", "_c"])
            .select("model", "alias", F.col("_new").alias("expr")))


def review_notes(decisions: DataFrame, events: DataFrame, pairs: DataFrame, confirmed: bool) -> DataFrame:
    """What a reviewer must look at before a fix merges, per incident."""
    shown = pairs.groupBy(*KEYS, "column_before").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "new_value", "old_value"))), lambda x: F.concat(x["new_value"], F.lit("→"), x["old_value"])), ", ")
        .alias("_map"))
    ids = decisions.select(*KEYS, "incident_id", "fix_action")
    table = _table()
    inferred = shown.join(ids, KEYS).select(
        "incident_id", F.explode(F.array(
            F.concat(F.lit("Codes "), "_map", F.lit(" were paired by their shares alone; the producer has to say what they mean.")),
            F.concat(F.col("column_before"), F.lit(" is missing since load "), "load_id", F.lit("; its last values are kept in "), table,
                     F.lit("_PRE_"), F.replace(F.col("incident_id"), F.lit("-"), F.lit("_")), F.lit("."))
        )).alias("note"))
    stuck = (events.where(F.col("subtype") == "column_dropped").select(*KEYS).distinct()
             .join(pairs.select(*KEYS).distinct(), KEYS, "left_anti").join(ids, KEYS)
             .select("incident_id", F.lit("Nothing could be paired with the lost column; a person has to decide.").alias("note")))
    waiting = ids.where((F.col("fix_action") == "normalize_after_confirmation") & F.lit(not confirmed)).select(
        "incident_id", F.lit("The producer has not confirmed the new unit yet.").alias("note"))
    h = F.col("evidence.hypothesis")
    known = F.coalesce(*[(h["factor"] == f) & (h["direction"] == d) for f, d in NORMALISERS], F.lit(False))
    unknown = (events.where((F.col("subtype") == "unit_change") & ~known & F.lit(confirmed)).join(ids, KEYS)
               .select("incident_id", F.concat(F.lit("No factor is known that undoes "), h["label"], F.lit(".")).alias("note")))
    return inferred.unionByName(stuck).unionByName(waiting).unionByName(unknown)
