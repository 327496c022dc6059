"""Incidents as an append-only log and the latest state it leads to."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTABLE = ["severity", "route", "blast_radius", "decision"]
FIXED = ["table_fqn", "load_id", "top_class"]


def incident_latest(log: DataFrame) -> DataFrame:
    """Current row per incident: identity from its first entry, mutable fields and status from the last entry
    that names them. Mitigation keeps its first time; the resolved time counts only while it is resolved.

    Partial aggregates only, so an incident with very many entries does not meet in one sort.
    """
    # the running number breaks ties and lets one aggregate hold value and order
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    contained = F.col("status").isin("MITIGATED", "RESOLVED")
    agg = log.groupBy("incident_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIXED],
        *[last(c) for c in MUTABLE if c in log.columns], last("status"), F.min("at").alias("opened_at"),
        F.min(F.when(contained, F.col("at"))).alias("mitigated_at"),
        F.max(F.when(F.col("status") == "RESOLVED", F.col("at"))).alias("_resolved"))
    status = F.coalesce("status", F.lit("OPEN"))
    return agg.withColumn("status", status).withColumn(
        "resolved_at", F.when(F.col("status") == "RESOLVED", F.col("_resolved"))).drop("_resolved")


def incident_entries(decisions: DataFrame, requests: DataFrame, at, first_seq: int = 0) -> DataFrame:
    """Log entries of a run: every drifted load opens its incident, contained ones are MITIGATED.

    `seq` grows with time: the run's own instant in microseconds, the opening before the containment.
    """
    drifted = decisions.where(F.col("top_class") != "no_drift")
    blast = F.to_json(F.struct("tier", "staging_models", "downstream_models", "exposures"))
    base = drifted.join(requests.select("table_fqn", "load_id", "mitigated"), ["table_fqn", "load_id"])
    status = F.explode(F.when(F.col("mitigated"), F.array(F.lit("OPEN"), F.lit("MITIGATED"))).otherwise(F.array(F.lit("OPEN"))))
    rows = base.select("incident_id", "table_fqn", "load_id", "top_class", "severity", "route",
                       blast.alias("blast_radius"), F.to_json(F.struct(*decisions.columns)).alias("decision"),
                       status.alias("status"))
    order = F.when(F.col("status") == "OPEN", 0).otherwise(1)
    micros = F.unix_micros(F.lit(at).cast("timestamp"))
    return rows.select((micros * 2 + order + F.lit(first_seq)).alias("seq"), F.lit(at).cast("timestamp_ntz").alias("at"), "*")


def incident_listing(incidents: DataFrame, limit: int = 50) -> DataFrame:
    """Newest incidents first; the limit is the page size of the listing."""
    return incidents.orderBy(F.desc("opened_at"), "incident_id").limit(limit)


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status") != "RESOLVED")


def replay_decisions(incidents: DataFrame, schema: str) -> DataFrame:
    """Stored decisions as typed rows again."""
    return incidents.select(F.from_json("decision", schema).alias("d")).select("d.*")
