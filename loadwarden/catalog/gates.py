"""Gate log, states, audits and listings, with the event stream read as a log of gate requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from loadwarden.catalog.given import ORDERS, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE
from loadwarden.operators import gate
from loadwarden.sources.bronze import observed_loads

LOG_SQL = """
log AS (
  SELECT event_id AS seq, 'lake.raw.t' || user_id AS table_fqn, 'E' || strftime(ts, '%Y%m%d') AS load_id,
         CASE event_type WHEN 'error' THEN 'QUARANTINED' WHEN 'view' THEN 'PASSED' WHEN 'purchase' THEN 'PASSED'
                         ELSE 'PENDING' END AS status,
         CASE WHEN event_type = 'error' THEN 'INC-' || event_id END AS incident_id, event_type AS decided_by,
         ts AS decided_at, CAST(floor(value) AS BIGINT) AS row_count, event_type = 'purchase' AS approved
  FROM events
),
audit AS (
  SELECT *, current = 'PENDING' OR (current = 'PASSED' AND status IN ('PASSED', 'QUARANTINED'))
            OR (current = 'QUARANTINED' AND (status = 'QUARANTINED' OR (status = 'PASSED' AND approved))) AS legal
  FROM (
    SELECT *, CASE WHEN q IS NOT NULL THEN CASE WHEN ap > q THEN 'PASSED' ELSE 'QUARANTINED' END
                   WHEN p IS NOT NULL THEN 'PASSED' ELSE 'PENDING' END AS current
    FROM (
      SELECT *, max(seq) FILTER (status = 'QUARANTINED') OVER b AS q,
             max(seq) FILTER (status = 'PASSED' AND approved) OVER b AS ap, max(seq) FILTER (status = 'PASSED') OVER b AS p
      FROM log WINDOW b AS (PARTITION BY table_fqn, load_id ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
),
latest AS (
  SELECT table_fqn, load_id, arg_min(row_count, seq) AS row_count,
         CASE WHEN max(seq) FILTER (status = 'QUARANTINED') IS NOT NULL
              THEN CASE WHEN max(seq) FILTER (status = 'PASSED' AND approved) > max(seq) FILTER (status = 'QUARANTINED')
                        THEN 'PASSED' ELSE 'QUARANTINED' END
              WHEN max(seq) FILTER (status = 'PASSED') IS NOT NULL THEN 'PASSED' ELSE 'PENDING' END AS status,
         arg_max(incident_id, seq) FILTER (incident_id IS NOT NULL) AS incident_id, arg_max(decided_by, seq) AS decided_by,
         max(decided_at) AS decided_at, min(decided_at) AS first_seen_at
  FROM audit WHERE legal GROUP BY table_fqn, load_id
)"""


def log(g: Given):
    """Each event asks for a gate status of a (table, day) load."""
    kind = F.col("event_type")
    status = (F.when(kind == "error", "QUARANTINED").when(kind.isin("view", "purchase"), "PASSED").otherwise("PENDING"))
    return g.table("events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("lake.raw.t"), F.col("user_id").cast("string")).alias("table_fqn"),
        F.concat(F.lit("E"), F.date_format("ts", "yyyyMMdd")).alias("load_id"), status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("INC-"), F.col("event_id").cast("string"))).alias("incident_id"),
        kind.alias("decided_by"), F.col("ts").alias("decided_at"), F.floor("value").cast("bigint").alias("row_count"),
        (kind == "purchase").alias("approved"))


def latest(g: Given):
    return gate.gate_latest(gate.accepted(log(g)))


@query("gate_transition_audit", f"""WITH {LOG_SQL}
SELECT seq, table_fqn, load_id, status, approved, current, legal FROM audit""")
def gate_transition_audit(g: Given):
    return gate.gate_audit(log(g)).select("seq", "table_fqn", "load_id", "status", "approved", "current", "legal")


@query("gate_latest", f"WITH {LOG_SQL} SELECT * FROM latest")
def gate_latest(g: Given):
    return latest(g)


@query("passed_loads", f"WITH {LOG_SQL} SELECT table_fqn, load_id FROM latest WHERE status = 'PASSED'")
def passed_loads(g: Given):
    return gate.passed_loads(latest(g))


@query("gate_listing", f"""WITH {LOG_SQL}
SELECT table_fqn, load_id, status, row_count FROM latest ORDER BY table_fqn, load_id DESC LIMIT 200""")
def gate_listing(g: Given):
    return gate.gate_listing(latest(g)).select("table_fqn", "load_id", "status", "row_count")


@query("new_loads", f"""WITH {BRONZE}
SELECT 'lake.raw.orders' AS table_fqn, _load_id AS load_id, count(*) AS row_count, max(_loaded_at) AS loaded_at
FROM bronze WHERE _load_id NOT IN (SELECT DISTINCT 'L' || year(o_orderdate) FROM orders WHERE o_orderdate < DATE '2000-01-01')
GROUP BY ALL""")
def new_loads(g: Given):
    """Loads of the orders feed that no gate row knows: here the gate has seen the years before 2000."""
    known = (g.table("orders").where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
             .select(F.lit(ORDERS).alias("table_fqn"), F.concat(F.lit("L"), F.year("o_orderdate").cast("string")).alias("load_id"))
             .distinct())
    return gate.new_loads(observed_loads(g.orders, ORDERS), known)


@query("baseline_loads", f"""WITH {LOG_SQL},
recent AS (SELECT table_fqn, load_id AS base_load_id, row_number() OVER (PARTITION BY table_fqn ORDER BY load_id DESC) AS base_rank
           FROM latest WHERE status = 'PASSED' QUALIFY base_rank <= 7)
SELECT c.table_fqn, c.load_id, r.base_load_id, r.base_rank FROM latest c JOIN recent r USING (table_fqn)
WHERE c.status = 'PENDING' AND r.base_load_id <> c.load_id""")
def baseline_loads(g: Given):
    rows = latest(g)
    return gate.baseline_loads(rows, rows.where(F.col("status") == "PENDING"))


@query("last_passed_snapshot", f"""WITH {LOG_SQL},
ids AS (SELECT table_fqn, load_id, lag(load_id) OVER (PARTITION BY table_fqn ORDER BY load_id) AS earlier FROM latest),
newest AS (SELECT table_fqn, max(load_id) AS passed FROM latest WHERE status = 'PASSED' GROUP BY 1)
SELECT i.table_fqn, i.load_id, coalesce(n.passed, i.earlier) AS before_id FROM ids i LEFT JOIN newest n USING (table_fqn)""")
def last_passed_snapshot(g: Given):
    rows = latest(g)
    return gate.last_passed_snapshot(rows.select("table_fqn", F.col("load_id").alias("snapshot_id")), rows, rows)
