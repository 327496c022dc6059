"""Times and costs of incidents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minutes_between(start: str, end: str) -> Column:
    """Whole seconds between two times, in minutes; null while either is missing."""
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", F.col(c)).cast("timestamp"))
    return (seconds(end) - seconds(start)) / 60.0


def _times() -> list[Column]:
    return [F.avg(minutes_between("opened_at", "mitigated_at")).alias("avg_minutes_to_mitigate"),
            F.avg(minutes_between("opened_at", "resolved_at")).alias("avg_minutes_to_resolve")]


def incident_mttr(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("top_class", "severity").agg(F.count(F.lit(1)).alias("incidents"), *_times())


def incident_cost(queries: DataFrame, attribution: DataFrame, app: str) -> DataFrame:
    """Queries and credits per (incident, agent), from tagged queries. Attribution is one row per query."""
    tag = lambda f: F.try_variant_get(F.try_parse_json("query_tag"), f"$.{f}", "string")
    tagged = queries.select("query_id", tag("app").alias("_app"), tag("incident").alias("incident_id"), tag("agent").alias("agent"))
    ours = tagged.where((F.col("_app") == app) & F.col("incident_id").isNotNull())
    return ours.join(attribution, "query_id", "left").groupBy("incident_id", "agent").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("credits").alias("credits"))


def ledger(incidents: DataFrame, cost: DataFrame) -> DataFrame:
    """Incidents, times and credits by class and severity; credits are summed per incident before the join."""
    per_incident = cost.groupBy("incident_id").agg(F.sum("credits").alias("credits"))
    return incidents.join(per_incident, "incident_id", "left").groupBy("top_class", "severity").agg(
        F.count(F.lit(1)).alias("incidents"), *_times(), F.sum("credits").alias("credits"))


def overview(incidents: DataFrame, gate: DataFrame) -> DataFrame:
    """One row of counters."""
    inc = incidents.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("status") != "RESOLVED").alias("open"),
                        *_times())
    held = gate.agg(F.count_if(F.col("status") == "QUARANTINED").alias("loads_quarantined"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731 - two single-row aggregates side by side
    return one(inc).join(one(held), "_one").drop("_one")


def incidents_by(incidents: DataFrame, column: str) -> DataFrame:
    return incidents.groupBy(column).agg(F.count(F.lit(1)).alias("incidents"))


def credits_by_agent(cost: DataFrame) -> DataFrame:
    """Credits per agent, and their total under a null agent."""
    return cost.rollup("agent").agg(F.sum("credits").alias("credits"))


def minutes_by_class(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("top_class").agg(*[F.round(c, 1).alias(n) for c, n in zip(_times(), ("ttm", "ttr"))])


def producers(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    """Incidents per owner of the drifted table."""
    owners = registry.select("table_fqn", "owner")
    return (incidents.groupBy("table_fqn").agg(F.count(F.lit(1)).alias("_n"))
            .join(owners, "table_fqn", "left").groupBy("owner").agg(F.sum("_n").alias("incidents")))


def noisiest_producer(incidents: DataFrame, registry: DataFrame) -> DataFrame:
    return producers(incidents, registry).orderBy(F.desc("incidents"), "owner").limit(1)
