"""Data tests and audits: keys, relationships, credentials in text, unchanged bronze, merge rules, policy tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.policy import Policy

# What a credential looks like.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN (?:RSA |ENCRYPTED )?PRIVATE KEY-----",
    "vcs_token": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    "tracker_token": r"\bATATT[A-Za-z0-9_\-=]{20,}\b",
}


def not_null_tests(model: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Failing rows of each column, all columns in one aggregate."""
    wide = model.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "failures").select(
        F.lit(name).alias("model"), "column_name", F.lit("not_null").alias("test"), "failures")


def unique_test(model: DataFrame, name: str, column: str) -> DataFrame:
    """Number of values that occur more than once."""
    repeated = model.where(F.col(column).isNotNull()).groupBy(column).count()
    return repeated.agg(F.count_if(F.col("count") > 1).alias("failures")).select(
        F.lit(name).alias("model"), F.lit(column).alias("column_name"), F.lit("unique").alias("test"), "failures")


def relationship_test(child: DataFrame, name: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key the parent lacks. Keys are counted first, so a hot key is one row in the join."""
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = keys.join(parent.select(F.col(parent_column).alias("_k")), "_k", "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures")).select(
        F.lit(name).alias("model"), F.lit(column).alias("column_name"), F.lit("relationships").alias("test"), "failures")


def secret_hits(rows: DataFrame, text: str, patterns: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    """One row per (row, pattern found), over whole texts; no shuffle."""
    found = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]),
                     lambda x: x.isNotNull())
    return rows.select("*", F.explode(found).alias("pattern"))


def secret_summary(rows: DataFrame, text: str, by: str, patterns: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    """Rows scanned and rows hit per pattern, per value of `by`."""
    wide = rows.groupBy(by).agg(F.count(F.lit(1)).alias("scanned"),
                                *[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in patterns.items()])
    return wide.unpivot([by, "scanned"], list(patterns), "pattern", "hits")


def row_digest(columns: list[str]) -> Column:
    """Hash of a row's values, to be summed. A null is hashed as a flag of its own, so a value that moves to an empty column changes it."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.isnull(f"`{c}`"), F.col(f"`{c}`").cast("string"))]).cast("decimal(38,0)")


def load_checksums(rows: DataFrame, load_col: str = "_load_id") -> DataFrame:
    """Row count and order-free checksum per load; the sum of 64-bit row hashes needs no sort and no distinct."""
    return rows.groupBy(F.col(load_col).alias("load_id")).agg(F.count(F.lit(1)).alias("row_count"),
                                                              F.sum(row_digest(rows.columns)).alias("checksum"))


def changed_loads(before: DataFrame, after: DataFrame) -> DataFrame:
    """Loads of an earlier audit that are gone or no longer the same: bronze must never be rewritten."""
    b = before.select("load_id", F.col("row_count").alias("rows_before"), F.col("checksum").alias("_before"))
    a = after.select("load_id", F.col("row_count").alias("rows_after"), F.col("checksum").alias("_after"))
    return b.join(a, "load_id", "left").select(
        "load_id", "rows_before", F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        (~F.col("_before").eqNullSafe(F.col("_after"))).alias("changed"))


def merge_audit(merges: DataFrame, policy: Policy) -> DataFrame:
    """merges: incident_id, severity, approved, ci_state, decisions -> the merge rules each one breaks."""
    rules = {
        "human_approval": F.col("severity").isin(*policy.human) & ~F.coalesce("approved", F.lit(False)),
        "tests_before_merge": ~F.col("ci_state").eqNullSafe(F.lit("success")),
        "decisions_traced": F.coalesce("decisions", F.lit(0)) == 0,
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return merges.select("*", broken.alias("violations"), (F.size(broken) == 0).alias("allowed"))


# Names of model-written text, which may never be an input of routing.
FREE_TEXT_INPUTS = ("narrative", "llm_output", "cortex_output", "completion")


def free_text_inputs(routing_input: DataFrame) -> list[str]:
    """Columns of a routing input that hold model-written text (there must be none)."""
    return sorted(set(FREE_TEXT_INPUTS) & set(routing_input.columns))


def policy_findings(spark, policy: Policy) -> DataFrame:
    """Inconsistencies of the policy tables: (check, subject); empty when all is well."""
    severity = policy.severity_table(spark)
    rank = F.substring("severity", 4, 1).cast("int")
    order = F.when(F.col("tier") == "low", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    by_tier = Window.partitionBy("top_class").orderBy(order)
    better = (severity.withColumn("_rank", rank).withColumn("_before", F.lag("_rank").over(by_tier))
              .where(F.col("_rank") > F.col("_before")).select(F.lit("severity_improves").alias("check"),
                                                               F.col("top_class").alias("subject")))
    classes = policy.precedence_table(spark).select(F.col("drift_class").alias("top_class"))
    playbooks = policy.playbook_table(spark)
    missing = classes.join(playbooks, "top_class", "left_anti").select(
        F.lit("no_playbook").alias("check"), F.col("top_class").alias("subject"))
    unranked = severity.select("top_class").distinct().join(classes, "top_class", "left_anti").select(
        F.lit("no_precedence").alias("check"), F.col("top_class").alias("subject"))
    soft = playbooks.where(F.col("top_class").isin("breaking", "semantic")
                           & ((F.col("gate") != "QUARANTINE") | F.col("auto_merge_when_green"))).select(
        F.lit("destructive_not_quarantined").alias("check"), F.col("top_class").alias("subject"))
    return reduce(DataFrame.unionByName, [better, missing, unranked, soft])
