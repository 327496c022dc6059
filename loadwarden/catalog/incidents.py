"""Incident lifecycle, times, costs and budgets, with the event stream read as incident log and query history."""
from __future__ import annotations

from pyspark.sql import functions as F

from loadwarden.catalog.gates import LOG_SQL
from loadwarden.catalog.gates import latest as gate_latest
from loadwarden.catalog.given import Given
from loadwarden.catalog.registry import query
from loadwarden.functions.ids import incident_from_branch
from loadwarden.functions.stats import budget_mode
from loadwarden.operators import incidents as inc
from loadwarden.operators import ledger as led
from loadwarden.operators.quality import merge_audit
from loadwarden.sources.control import absent
from loadwarden.sources.registry import watch_registry

APP = "warden"
_CLASS = {"click": "additive", "view": "rename", "error": "breaking", "purchase": "semantic", "signup": "type_widening"}

INCIDENTS_SQL = """
entries AS (
  SELECT event_id AS seq, ts AS happened, 'INC-' || user_id || '-' || strftime(ts, '%Y%m%d') AS incident_id,
         'lake.raw.' || event_type AS table_fqn, 'E' || strftime(ts, '%Y%m%d') AS load_id,
         CASE event_type WHEN 'click' THEN 'additive' WHEN 'view' THEN 'rename' WHEN 'error' THEN 'breaking'
                         WHEN 'purchase' THEN 'semantic' ELSE 'type_widening' END AS top_class,
         'SEV' || (1 + least(3, CAST(floor(value / 50) AS INTEGER))) AS severity, event_type AS route,
         CASE event_type WHEN 'purchase' THEN 'RESOLVED' WHEN 'signup' THEN 'MITIGATED' ELSE 'OPEN' END AS status
  FROM events),
incidents AS (
  SELECT incident_id, arg_min(table_fqn, seq) AS table_fqn, arg_min(load_id, seq) AS load_id, arg_min(top_class, seq) AS top_class,
         arg_max(severity, seq) AS severity, arg_max(route, seq) AS route, arg_max(status, seq) AS status, min(happened) AS opened_at,
         min(happened) FILTER (status IN ('MITIGATED', 'RESOLVED')) AS mitigated_at,
         CASE WHEN arg_max(status, seq) = 'RESOLVED' THEN max(happened) FILTER (status = 'RESOLVED') END AS resolved_at
  FROM entries GROUP BY 1),
timed AS (
  SELECT *, date_diff('second', date_trunc('second', opened_at), date_trunc('second', mitigated_at)) / 60.0 AS ttm,
         date_diff('second', date_trunc('second', opened_at), date_trunc('second', resolved_at)) / 60.0 AS ttr FROM incidents),
cost AS (
  SELECT 'INC-' || user_id || '-' || strftime(ts, '%Y%m%d') AS incident_id, event_type AS agent, count(*) AS queries,
         sum(CASE WHEN value >= 1 THEN value / 1000 END) AS credits
  FROM events WHERE value < 200 AND event_type <> 'signup' GROUP BY ALL)"""


def _incident_id():
    return F.concat(F.lit("INC-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))


def entries(g: Given):
    kind = F.col("event_type")
    top = F.coalesce(*[F.when(kind == k, v) for k, v in _CLASS.items()])
    return g.table("events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), _incident_id().alias("incident_id"),
        F.concat(F.lit("lake.raw."), kind).alias("table_fqn"), F.concat(F.lit("E"), F.date_format("ts", "yyyyMMdd")).alias("load_id"),
        top.alias("top_class"),
        F.concat(F.lit("SEV"), (1 + F.least(F.lit(3), F.floor(F.col("value") / 50).cast("int"))).cast("string")).alias("severity"),
        kind.alias("route"),
        F.when(kind == "purchase", "RESOLVED").when(kind == "signup", "MITIGATED").otherwise("OPEN").alias("status"))


def incidents(g: Given):
    return inc.incident_latest(entries(g))


def costs(g: Given):
    """Tagged queries: the tag is JSON text, as a warehouse's query history keeps it."""
    e = g.table("events")
    tag = F.to_json(F.struct(
        F.when(F.col("value") < 200, APP).otherwise("other").alias("app"), F.col("event_type").alias("agent"),
        F.when(F.col("event_type") != "signup", _incident_id()).alias("incident")))
    queries = e.select(F.col("event_id").alias("query_id"), tag.alias("query_tag"))
    attribution = e.where(F.col("value") >= 1).select(F.col("event_id").alias("query_id"), (F.col("value") / 1000).alias("credits"))
    return led.incident_cost(queries, attribution, APP)


@query("incident_latest", f"WITH {INCIDENTS_SQL} SELECT * FROM incidents")
def incident_latest(g: Given):
    return incidents(g)


@query("incident_listing", f"""WITH {INCIDENTS_SQL}
SELECT incident_id, top_class, severity, status, opened_at FROM incidents ORDER BY opened_at DESC, incident_id LIMIT 50""")
def incident_listing(g: Given):
    return inc.incident_listing(incidents(g)).select("incident_id", "top_class", "severity", "status", "opened_at")


@query("incident_mttr", f"""WITH {INCIDENTS_SQL}
SELECT top_class, severity, count(*) AS incidents, round(avg(ttm), 6) AS avg_minutes_to_mitigate,
       round(avg(ttr), 6) AS avg_minutes_to_resolve FROM timed GROUP BY ALL""")
def incident_mttr(g: Given):
    return _rounded(led.incident_mttr(incidents(g)))


def _rounded(df, digits: int = 6):
    numbers = [c for c in ("avg_minutes_to_mitigate", "avg_minutes_to_resolve", "credits") if c in df.columns]
    return df.withColumns({c: F.round(c, digits) for c in numbers})


@query("incident_cost", f"WITH {INCIDENTS_SQL} SELECT incident_id, agent, queries, round(credits, 6) AS credits FROM cost")
def incident_cost(g: Given):
    return _rounded(costs(g))


@query("ledger", f"""WITH {INCIDENTS_SQL}
SELECT top_class, severity, count(*) AS incidents, round(avg(ttm), 6) AS avg_minutes_to_mitigate,
       round(avg(ttr), 6) AS avg_minutes_to_resolve, round(sum(c.credits), 6) AS credits
FROM timed LEFT JOIN (SELECT incident_id, sum(credits) AS credits FROM cost GROUP BY 1) c USING (incident_id) GROUP BY ALL""")
def ledger(g: Given):
    return _rounded(led.ledger(incidents(g), costs(g)))


@query("overview_counters", f"""WITH {LOG_SQL}, {INCIDENTS_SQL}
SELECT count(*) AS incidents, count(*) FILTER (status <> 'RESOLVED') AS open, round(avg(ttm), 6) AS avg_minutes_to_mitigate,
       round(avg(ttr), 6) AS avg_minutes_to_resolve,
       (SELECT count(*) FROM latest WHERE status = 'QUARANTINED') AS loads_quarantined FROM timed""")
def overview_counters(g: Given):
    return _rounded(led.overview(incidents(g), gate_latest(g)))


@query("incidents_by_class", f"WITH {INCIDENTS_SQL} SELECT top_class, count(*) AS incidents FROM incidents GROUP BY 1")
def incidents_by_class(g: Given):
    return led.incidents_by(incidents(g), "top_class")


@query("incidents_by_severity", f"WITH {INCIDENTS_SQL} SELECT severity, count(*) AS incidents FROM incidents GROUP BY 1")
def incidents_by_severity(g: Given):
    return led.incidents_by(incidents(g), "severity")


@query("credits_by_agent", f"WITH {INCIDENTS_SQL} SELECT agent, round(sum(credits), 6) AS credits FROM cost GROUP BY ROLLUP (agent)")
def credits_by_agent(g: Given):
    return _rounded(led.credits_by_agent(costs(g)))


@query("minutes_by_class", f"WITH {INCIDENTS_SQL} SELECT top_class, round(avg(ttm), 1) AS ttm, round(avg(ttr), 1) AS ttr FROM timed GROUP BY 1")
def minutes_by_class(g: Given):
    return led.minutes_by_class(incidents(g))


@query("open_incidents", f"WITH {INCIDENTS_SQL} SELECT incident_id, status FROM incidents WHERE status <> 'RESOLVED'")
def open_incidents(g: Given):
    return inc.open_incidents(incidents(g)).select("incident_id", "status")


_TEAMS = {"click": "web", "view": "web", "error": "platform", "purchase": "payments", "signup": "growth"}


def _registry(g: Given):
    return watch_registry(g.spark, [(f"lake.raw.{k}", True, "id", team) for k, team in _TEAMS.items()])


_OWNED = f"""owned AS (SELECT CASE table_fqn WHEN 'lake.raw.click' THEN 'web' WHEN 'lake.raw.view' THEN 'web'
  WHEN 'lake.raw.error' THEN 'platform' WHEN 'lake.raw.purchase' THEN 'payments' ELSE 'growth' END AS owner, count(*) AS incidents
  FROM incidents GROUP BY 1)"""


@query("producers", f"WITH {INCIDENTS_SQL}, {_OWNED} SELECT owner, incidents FROM owned")
def producers(g: Given):
    return led.producers(incidents(g), _registry(g))


@query("noisiest_producer", f"WITH {INCIDENTS_SQL}, {_OWNED} SELECT owner, incidents FROM owned ORDER BY incidents DESC, owner LIMIT 1")
def noisiest_producer(g: Given):
    return led.noisiest_producer(incidents(g), _registry(g))


@query("event_inserts", f"""WITH {INCIDENTS_SQL}
SELECT DISTINCT incident_id FROM entries WHERE incident_id NOT IN (SELECT incident_id FROM entries WHERE status = 'OPEN')""")
def event_inserts(g: Given):
    """Ids to insert when those of the open entries are stored already: each absent id once."""
    rows = entries(g)
    return absent(rows.select("incident_id"), rows.where(F.col("status") == "OPEN"), ["incident_id"])


@query("budget_modes", """SELECT user_id, round(sum(value), 4) AS spent,
  CASE WHEN sum(value) / 4000.0 >= 1 THEN 'paused' WHEN sum(value) / 4000.0 >= 0.8 THEN 'critical_only' ELSE 'normal' END AS mode
FROM events GROUP BY 1""")
def budget_modes(g: Given):
    spend = g.table("events").groupBy("user_id").agg(F.sum("value").alias("_spent"))
    return spend.select("user_id", F.round("_spent", 4).alias("spent"), budget_mode(F.col("_spent"), F.lit(4000.0)).alias("mode"))


@query("branch_incidents", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  ELSE 'INC-' || upper(substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) END AS incident_id FROM events""")
def branch_incidents(g: Given):
    """Incident named by a branch of each event; branches of errors carry no valid id."""
    digest = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8)
    kind = F.col("event_type")
    ref = (F.when(kind == "error", F.concat(F.lit("main/inc-"), digest))
           .when(kind == "view", F.concat(F.lit("refs/heads/fix/inc-"), digest, F.lit("-rename")))
           .otherwise(F.concat(F.lit("fix/INC-"), digest, F.lit("-breaking"))))
    return g.table("events").select("event_id", incident_from_branch(ref).alias("incident_id"))


@query("merge_audit", f"""WITH {INCIDENTS_SQL},
merges AS (SELECT seq, severity, status = 'RESOLVED' AS approved, CASE route WHEN 'error' THEN 'failure' WHEN 'view' THEN NULL ELSE 'success' END AS ci_state,
                  CASE WHEN top_class = 'type_widening' THEN 0 ELSE 1 END AS decisions FROM entries)
SELECT seq, concat_ws(',', CASE WHEN severity IN ('SEV1', 'SEV2') AND NOT approved THEN 'human_approval' END,
                      CASE WHEN ci_state IS DISTINCT FROM 'success' THEN 'tests_before_merge' END,
                      CASE WHEN decisions = 0 THEN 'decisions_traced' END) AS violations,
       NOT (severity IN ('SEV1', 'SEV2') AND NOT approved) AND ci_state IS NOT DISTINCT FROM 'success' AND decisions > 0 AS allowed FROM merges""")
def merges(g: Given):
    """Merge rules over one merge request per event."""
    rows = entries(g).select(
        "seq", "incident_id", "severity", (F.col("status") == "RESOLVED").alias("approved"),
        F.when(F.col("route") == "error", "failure").when(F.col("route") != "view", "success").alias("ci_state"),
        F.when(F.col("top_class") == "type_widening", 0).otherwise(1).alias("decisions"))
    return merge_audit(rows, g.policy).select("seq", F.array_join("violations", ",").alias("violations"), "allowed")
