"""From events and blast radius to one decision per load, its trace, and what the gate is told."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.functions import text
from loadwarden.functions.ids import incident_id
from loadwarden.operators.classify import event_order
from loadwarden.policy import GATE_STATUS, NO_DRIFT_SEVERITY, Policy

KEYS = ["table_fqn", "load_id"]
# Decision fields that two runs over the same load must agree on.
DETERMINED = ["incident_id", "top_class", "severity", "route", "gate", "requires_human_approval"]


def top_classes(events: DataFrame, policy: Policy) -> DataFrame:
    """Highest-precedence class per load and its event ids."""
    rank = F.coalesce(*[F.when(F.col("drift_class") == c, i) for i, c in enumerate(policy.precedence)])
    return events.groupBy(*KEYS).agg(F.min_by("drift_class", rank).alias("top_class"),
                                     F.array_sort(F.collect_list("event_id")).alias("event_ids"),
                                     F.array_sort(F.collect_set("drift_class")).alias("classes"))


def route(loads: DataFrame, events: DataFrame, blast: DataFrame, policy: Policy) -> DataFrame:
    """One decision per load, drifted or clean. The policy tables hold one row per class (and tier)."""
    spark = loads.sparkSession
    severity = F.broadcast(policy.severity_table(spark))
    playbook = F.broadcast(policy.playbook_table(spark))
    sized = blast.select(*KEYS, "tier", F.size("downstream_models").alias("n_downstream"), "n_exposures",
                         "staging_models", "downstream_models", F.transform("exposures", lambda x: x["name"]).alias("exposures"))
    names = F.array().cast("array<string>")
    rows = (loads.select(*KEYS).join(top_classes(events, policy), KEYS, "left").join(sized, KEYS, "left")
            .withColumn("top_class", F.coalesce("top_class", F.lit("no_drift")))
            .withColumn("tier", F.coalesce("tier", F.lit("low")))
            .join(severity, ["top_class", "tier"], "left").join(playbook, "top_class"))
    sev = F.coalesce("severity", F.lit(NO_DRIFT_SEVERITY))
    human = sev.isin(*policy.human)
    return rows.select(
        incident_id(F.col("table_fqn"), F.col("load_id"), F.col("event_ids")).alias("incident_id"), *KEYS, "top_class",
        sev.alias("severity"), "route", "gate", "fix_action", "notify_action", human.alias("requires_human_approval"),
        (F.col("auto_merge_when_green") & ~human).alias("auto_merge_when_green"), "sla_minutes", "tier",
        F.coalesce("n_downstream", F.lit(0)).alias("n_downstream"), F.coalesce("n_exposures", F.lit(0)).alias("n_exposures"),
        F.coalesce("staging_models", names).alias("staging_models"),
        F.coalesce("downstream_models", names).alias("downstream_models"),
        F.coalesce("exposures", names).alias("exposures"), F.coalesce("event_ids", names).alias("event_ids"),
        F.coalesce("classes", names).alias("classes"))


def primary_events(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """The event that decided each load's class: the first of that class in event order."""
    order = Window.partitionBy(*KEYS).orderBy(*event_order())
    return (events.join(decisions.select(*KEYS, "top_class"), KEYS)
            .where(F.col("drift_class") == F.col("top_class"))
            .withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "top_class"))


def incident_texts(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Headline and producer note per decision; `decisions` carries the owner of each table."""
    first = primary_events(decisions, events)
    e = lambda c: F.col(f"e.{c}")
    d = decisions.alias("d").join(first.alias("e"), KEYS, "left")
    return d.select(*KEYS, "d.incident_id",
                    text.headline(F.col("table_fqn"), F.col("d.severity"), F.col("d.top_class"), e).alias("headline"),
                    text.producer_note(F.col("d.top_class"), F.col("d.gate"), F.col("d.owner"), e).alias("producer_note"))


def gate_requests(decisions: DataFrame, mode: str, decided_by: str = "diagnosis") -> DataFrame:
    """Status each load asks for. Only `protect` enforces a playbook; other modes pass the load and say what
    would have happened."""
    would = F.coalesce(*[F.when(F.col("gate") == g, s) for g, s in GATE_STATUS.items()])
    enforce = mode == "protect"
    return decisions.select(
        *KEYS, "incident_id", would.alias("playbook_status"),
        (would if enforce else F.lit("PASSED")).alias("status"),
        (F.lit(not enforce) & (would != "PASSED")).alias("advisory"),
        F.when(F.col("top_class") == "no_drift", f"{decided_by}:clean")
        .otherwise(decided_by if enforce else f"{decided_by}:{mode}").alias("decided_by"),
        (F.col("gate").isin("HOLD", "QUARANTINE") & F.lit(enforce)).alias("mitigated"),
        ((F.col("fix_action") != "none") & (F.col("fix_action") != "normalize_after_confirmation")
         & F.lit(mode in ("advise", "protect"))).alias("fix_proposed"))


def decision_trace(decisions: DataFrame, events: DataFrame, diff_summary: DataFrame, policy: Policy,
                   rejections: DataFrame | None = None) -> DataFrame:
    """What was decided, why, and how sure, one row per step: the schema difference, each event (last first),
    then class, severity, gate and approval. `rejections` holds the pairs that are no rename and why; each stands with every event that
    names one of its sides."""
    joined = lambda c: F.array_join(F.col(c), ", ")
    base = decisions.join(diff_summary, KEYS, "left").withColumn("_n", F.size("event_ids"))

    def row(step, decision, choice, reasoning, alternatives=None):
        return base.select("incident_id", *KEYS, step.cast("int").alias("step"), F.lit(decision).alias("decision"),
                           choice.alias("choice"), reasoning.alias("reasoning"),
                           (F.lit("") if alternatives is None else alternatives).alias("alternatives"),
                           F.lit("high").alias("confidence"))

    part = lambda c: F.coalesce(c, F.lit(""))
    schema = row(F.lit(0), "schema_diff",
                 F.concat(F.lit("added="), part("added"), F.lit(" dropped="), part("dropped"), F.lit(" type_changed="),
                          part("type_changed")),
                 F.lit("schema of the last PASSED load against the schema of the new load"))
    order = Window.partitionBy(*KEYS).orderBy(*event_order())
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    ranked = events.withColumn("step", (n - F.row_number().over(order) + 1).cast("int"))
    if rejections is None:
        ranked = ranked.withColumn("_rejected", F.lit(""))
    else:
        sides = [events.select("event_id", *KEYS, c).join(rejections.select(*KEYS, "column_before", "column_after", "reason"), [*KEYS, c])
                 .select("event_id", "column_before", "column_after", "reason") for c in ("column_before", "column_after")]
        named = sides[0].union(sides[1]).groupBy("event_id").agg(
            F.array_sort(F.collect_set(F.struct("column_before", "column_after", "reason"))).alias("_pairs"))
        ranked = ranked.join(named, "event_id", "left").withColumn("_rejected", F.array_join(F.transform("_pairs", lambda r: F.concat(
            r["column_before"], F.lit("→"), r["column_after"], F.lit(": "), r["reason"])), "; "))
    classified = ranked.join(decisions.select(*KEYS, "incident_id"), KEYS).select(
        "incident_id", *KEYS, "step", F.concat(F.lit("classify:"), F.coalesce("column_before", "column_after")).alias("decision"),
        F.concat("drift_class", F.lit("/"), "subtype").alias("choice"), text.event_reason(F.col).alias("reasoning"),
        F.coalesce("_rejected", F.lit("")).alias("alternatives"),
        F.when(F.col("confidence") >= 0.9, "high").otherwise("medium").alias("confidence"))
    after = F.col("_n")
    top = row(after + 1, "top_class", F.col("top_class"),
              F.concat(F.lit("highest precedence among "), F.when(F.size("classes") > 0, joined("classes")).otherwise("none"),
                       F.lit(f" in the order {', '.join(policy.precedence)}")))
    severity = row(after + 2, "severity", F.col("severity"),
                   F.concat(F.lit("severity["), "top_class", F.lit("]["), "tier", F.lit("]; "),
                            F.col("n_downstream").cast("string"), F.lit(" downstream models, "),
                            F.col("n_exposures").cast("string"), F.lit(" exposures")))
    gates = F.array(*[F.lit(g) for g in GATE_STATUS])
    gate = row(after + 3, "gate", F.col("gate"), F.concat(F.lit("playbook "), "route", F.lit(" for class "), "top_class"),
               F.array_join(F.array_remove(gates, F.col("gate")), ", "))
    human = row(after + 4, "human_approval", F.col("requires_human_approval").cast("string"),
                F.concat("severity", F.when(F.col("requires_human_approval"), " is").otherwise(" is not"),
                         F.lit(f" among {', '.join(policy.human)}")))
    return reduce(DataFrame.unionByName, [schema, classified, top, severity, gate, human])


def determinism_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per load: decision fields on which two runs disagree (0 everywhere when routing is deterministic)."""
    a, b = first.alias("a"), second.alias("b")
    unequal = [F.when(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 0).otherwise(1) for c in DETERMINED]
    return a.join(b, KEYS, "full_outer").select(*KEYS, reduce(lambda x, y: x + y, unequal).alias("differences"))
