"""Drift detection and routing over the variants of the newest orders load."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loadwarden.catalog.given import EDGES, NODES, ORDERS, OWNERS, PROJECT, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE, DETECT, values
from loadwarden.operators import lineage, rename, routing, semantic
from loadwarden.operators.gate import gate_latest
from loadwarden.operators.schema_diff import diff_summary, schema_diff
from loadwarden.plans.detect import decide
from loadwarden.plans.scan import Lineage, WatchedTable, bootstrap, scan
from loadwarden.policy import CLASS_PRECEDENCE, PLAYBOOKS, SEVERITY
from loadwarden.session import scratch_path, write_through
from loadwarden.sources import bronze
from loadwarden.sources.control import ControlPlane
from loadwarden.sources.registry import with_owner


def _diff(g: Given):
    return g.structure[1]


def _baseline(g: Given):
    return g.structure[0]


# ------------------------------------------------------------------ schemas

_SUMMARY = values([
    ("L2001.additive", "ORDER_MONTH", "", "", 6), ("L2001.breaking", "SETTLED", "STATUS", "", 5),
    ("L2001.clean", "", "", "", 6), ("L2001.codes", "", "", "", 6), ("L2001.rename", "CUSTOMER_KEY", "CUST_ID", "", 5),
    ("L2001.replaced", "ACCOUNT_NO,CHANNEL_CODE", "CHANNEL,CUST_ID", "", 4), ("L2001.semantic", "", "", "", 6),
    ("L2001.widening", "", "", "AMOUNT:NUMBER(12,2)→NUMBER(18,2)", 5)])


@query("schema_diff", f"""WITH {BRONZE}
SELECT s.*, n.row_count FROM (SELECT * FROM ({_SUMMARY}) t(load_id, added, dropped, type_changed, unchanged_columns)) s,
  (SELECT count(*) AS row_count FROM bronze WHERE _load_id = 'L2001') n""")
def schema_diffs(g: Given):
    """Schema changes of each variant of the new load, beside the size of the load."""
    rows = None
    for k, df in g.variants.items():
        one = bronze.observed_loads(df, ORDERS).select("load_id", "row_count")
        rows = one if rows is None else rows.unionByName(one)
    return diff_summary(_diff(g)).drop("table_fqn").join(rows, "load_id")


_RETYPED = {"amount": ("double", "NUMBER(12,2)", "FLOAT", "widening_lossy", "lossy_widening"),
            "order_ts": ("date", "TIMESTAMP_NTZ", "DATE", "incompatible", "type_incompatible"),
            "cust_id": ("string", "NUMBER(19,0)", "VARCHAR", "widening_lossy", "lossy_widening"),
            "order_id": ("smallint", "NUMBER(19,0)", "NUMBER(5,0)", "narrowing", "type_narrowing")}
_KEPT = {"amount": "count(*)", "order_ts": "count(*) FILTER (order_ts = CAST(CAST(order_ts AS DATE) AS TIMESTAMP))",
         "cust_id": "count(*)", "order_id": "count(*) FILTER (order_id BETWEEN -32768 AND 32767)"}


@query("type_changes", f"WITH {BRONZE} " + " UNION ALL ".join(
    f"SELECT '{c.upper()}' AS column_name, '{old}' AS type_before, '{new}' AS type_after, '{rel}' AS type_relation, "
    f"'{sub}' AS subtype, count(*) AS row_count, {_KEPT[c]} AS rows_kept FROM bronze"
    for c, (_, old, new, rel, sub) in _RETYPED.items()))
def type_changes(g: Given):
    """Every column of the feed under a new type: how the lattice ranks the change, and how many values survive it."""
    cast = {c: F.col(c).try_cast(t) for c, (t, *_) in _RETYPED.items()}
    after = g.orders.withColumns(cast)
    snaps = bronze.schema_snapshots(g.spark, {(ORDERS, "before"): g.orders.schema, (ORDERS, "changed"): after.schema})
    pairs = g.spark.createDataFrame([(ORDERS, "changed", "before")], "table_fqn string, load_id string, before_id string")
    relation = F.col("type_relation")
    subtype = (F.when(relation == "widening", "lossless_widening").when(relation == "widening_lossy", "lossy_widening")
               .when(relation == "narrowing", "type_narrowing").otherwise("type_incompatible"))
    changed = schema_diff(snaps, pairs).where(F.col("change") == "type_changed").select(
        F.col("column_before").alias("column_name"), "type_before", "type_after", "type_relation", subtype.alias("subtype"))
    types = dict(g.orders.dtypes)
    kept = [F.count_if(F.col(c).try_cast(t).try_cast(types[c]) == F.col(c)).alias(c.upper()) for c, (t, *_) in _RETYPED.items()]
    counted = g.orders.agg(F.count(F.lit(1)).alias("row_count"), *kept).unpivot(
        "row_count", [c.upper() for c in _RETYPED], "column_name", "rows_kept")
    return changed.join(counted, "column_name")


# ------------------------------------------------------------------ renames

@query("containment_exact", f"""WITH {DETECT}
SELECT 'L2001.rename' AS load_id, 'CUST_ID' AS column_before, 'CUSTOMER_KEY' AS column_after, c AS containment FROM containment""")
def containment_exact(g: Given):
    return rename.exact_containment(_diff(g), g.compared, g.changed_counts).drop("table_fqn")


@query("rename_pairs", f"""WITH {DETECT}
SELECT 'L2001.rename' AS load_id, 'CUST_ID' AS column_before, 'CUSTOMER_KEY' AS column_after, score, c AS value_containment,
       1.0::DOUBLE AS null_similarity, r AS distinct_ratio, 'same' AS type_relation FROM fingerprint WHERE score >= 0.9""")
def rename_pairs(g: Given):
    return rename.rename_pairs(g.scored).drop("table_fqn", "type_before", "type_after")


@query("rename_rejections", f"WITH {DETECT} SELECT * FROM rejected")
def rename_rejections(g: Given):
    return g.scored.where(F.col("reason").isNotNull()).select("load_id", "column_before", "column_after", "reason")


# ------------------------------------------------------------------ meaning

@query("numeric_semantic", f"""WITH {DETECT}
SELECT load_id, column_name, round(med, 4) AS baseline_median, round(m, 4) AS new_median, round(ratio, 4) AS ratio_baseline_over_new,
       round(factor, 4) AS factor, round(z, 1) AS robust_z, flagged, direction FROM numeric_tests""")
def numeric_semantic(g: Given):
    return semantic.numeric_checks(_diff(g), g.medians, _baseline(g), g.policy.thresholds, g.key_columns).select(
        "load_id", "column_name", "baseline_median", "new_median", "ratio_baseline_over_new", "factor", "robust_z", "flagged",
        F.col("hypothesis.direction").alias("direction"))


@query("restatement_ratio", f"""WITH {DETECT}
SELECT load_id, matched_rows, round(ratio_median, 6) AS ratio_median, round(ratio_cv, 8) AS ratio_cv FROM restated""")
def restatement_ratio(g: Given):
    return g.restated.select("load_id", "matched_rows", F.round("ratio_median", 6).alias("ratio_median"),
                             F.round("ratio_cv", 8).alias("ratio_cv"))


def _shares(g: Given):
    return semantic.category_shares(_diff(g), g.top_lists, _baseline(g), g.policy.thresholds, g.key_columns)


@query("category_shares", f"""WITH {DETECT}
SELECT load_id, column_name, value, round(expected, 9) AS expected, round(actual, 9) AS actual FROM category_shares""")
def category_shares(g: Given):
    return _shares(g).select("load_id", "column_name", "value", F.round("expected", 9).alias("expected"),
                             F.round("actual", 9).alias("actual"))


@query("categorical_semantic", f"""WITH {DETECT}
SELECT load_id, column_name, round(psi, 3) AS psi, round(overlap, 3) AS domain_overlap, flagged, subtype FROM category_tests""")
def categorical_semantic(g: Given):
    return semantic.categorical_checks(_shares(g), g.policy.thresholds).select(
        "load_id", "column_name", "psi", "domain_overlap", "flagged", "subtype")


# ------------------------------------------------------------------ events, blast radius, routes

@query("drift_events", f"WITH {DETECT} SELECT * FROM events")
def drift_events(g: Given):
    return g.events.drop("table_fqn", "evidence")


_GRAPH = f"""edges(src, dst) AS ({values(EDGES)}),
nodes(id, kind, name, label, type, owner, tier, audience) AS ({values(NODES)}),
reach AS (
  WITH RECURSIVE r(node) AS (SELECT 'model.shop.stg_orders' UNION SELECT dst FROM r JOIN edges ON src = node)
  SELECT node FROM r WHERE node <> 'model.shop.stg_orders'),
consumed AS (SELECT DISTINCT load_id, unnest([column_before, column_after]) AS c FROM events WHERE drift_class <> 'additive'),
hit AS (SELECT DISTINCT load_id FROM consumed WHERE c IN ('ORDER_ID', 'CUST_ID', 'ORDER_TS', 'AMOUNT', 'STATUS', 'CHANNEL')),
blast AS (
  SELECT e.load_id,
    coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM consumed x WHERE x.load_id = e.load_id AND c IS NOT NULL), '') AS columns,
    CASE WHEN h.load_id IS NULL THEN '' ELSE 'stg_orders' END AS staging_models,
    CASE WHEN h.load_id IS NULL THEN '' ELSE (SELECT string_agg(split_part(node, '.', 3), ',' ORDER BY node) FROM reach
                                              WHERE node LIKE 'model.%') END AS downstream_models,
    CASE WHEN h.load_id IS NULL THEN '' ELSE (SELECT string_agg(split_part(node, '.', 3), ',' ORDER BY node) FROM reach
                                              WHERE node LIKE 'exposure.%') END AS exposures,
    CASE WHEN h.load_id IS NULL THEN 0 ELSE (SELECT count(*) FROM reach WHERE node LIKE 'exposure.%') END AS n_exposures,
    CASE WHEN h.load_id IS NULL THEN 'low' ELSE 'high' END AS tier
  FROM (SELECT DISTINCT load_id FROM events) e LEFT JOIN hit h USING (load_id))"""


@query("blast_radius", f"WITH {DETECT}, {_GRAPH} SELECT * FROM blast")
def blast_radius(g: Given):
    nodes, edges = g.lineage
    b = lineage.blast_radius(g.detection.events, g.column_map, nodes, edges, "shop", g.policy.blast)
    names = {c: F.array_join(c, ",") for c in ("columns", "staging_models", "downstream_models")}
    return b.withColumns(names).withColumn("exposures", F.coalesce(F.array_join(F.transform(
        "exposures", lambda x: x["name"]), ","), F.lit(""))).drop("table_fqn")


@query("exposures_hit", f"""WITH {DETECT}, {_GRAPH}
SELECT h.load_id, n.name, n.label, n.type, n.owner, coalesce(n.tier, 9) AS tier, n.audience
FROM hit h, reach r JOIN nodes n ON n.id = r.node WHERE n.kind = 'exposure'""")
def exposures_hit(g: Given):
    nodes, edges = g.lineage
    b = lineage.blast_radius(g.detection.events, g.column_map, nodes, edges, "shop", g.policy.blast)
    return b.select("load_id", F.explode("exposures").alias("x")).select("load_id", "x.name", "x.label", "x.type", "x.owner",
                                                                         "x.tier", "x.audience")


@query("downstream_closure", """
WITH RECURSIVE edges AS (
  SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
reach AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node FROM region
          UNION SELECT start, dst FROM reach JOIN edges ON src = node)
SELECT start, substr(node, 1, 1) AS kind, count(*) AS nodes FROM reach WHERE node NOT LIKE 'r%' GROUP BY ALL""")
def downstream_closure(g: Given):
    """The closure on a graph that grows with the data: regions, nations, customers, suppliers and orders."""
    def edge(df, src, a, dst, b):
        return df.select(F.concat(F.lit(src), F.col(a).cast("string")).alias("src"),
                         F.concat(F.lit(dst), F.col(b).cast("string")).alias("dst"))

    edges = (edge(g.table("nation"), "r", "n_regionkey", "n", "n_nationkey")
             .unionByName(edge(g.table("customer"), "n", "c_nationkey", "c", "c_custkey"))
             .unionByName(edge(g.table("supplier"), "n", "s_nationkey", "s", "s_suppkey"))
             .unionByName(edge(g.table("orders"), "c", "o_custkey", "o", "o_orderkey")))
    starts = g.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return lineage.downstream(edges, starts).groupBy("start", F.substring("node", 1, 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("nodes"))


_PRECEDENCE = values([(c, i) for i, c in enumerate(CLASS_PRECEDENCE)])
_ROUTES = f"""precedence(c, p) AS ({_PRECEDENCE}),
severity(c, tier, severity) AS ({values([(c, t, s) for c, ts in SEVERITY.items() for t, s in ts.items()])}),
playbook(c, route, gate, fix_action, notify_action, auto_merge, sla_minutes) AS ({values([(c, *p) for c, p in PLAYBOOKS.items()])}),
per_load AS (
  SELECT load_id, arg_min(drift_class, p) AS top_class, string_agg(event_id, '","' ORDER BY event_id) AS ids, count(*) AS n_events,
         string_agg(DISTINCT drift_class, ', ' ORDER BY drift_class) AS classes
  FROM events JOIN precedence ON c = drift_class GROUP BY 1),
decisions AS (
  SELECT 'L2001.' || kind AS load_id,
    CASE WHEN l.ids IS NULL THEN 'OK-' || upper(substr(sha256('["lake.raw.orders","L2001.' || kind || '"]'), 1, 8))
         ELSE 'INC-' || upper(substr(sha256('["lake.raw.orders","L2001.' || kind || '",["' || l.ids || '"]]'), 1, 8)) END AS incident_id,
    coalesce(l.top_class, 'no_drift') AS top_class, coalesce(s.severity, 'SEV5') AS severity, pb.route, pb.gate, pb.fix_action,
    pb.notify_action, coalesce(s.severity, 'SEV5') IN ('SEV1', 'SEV2') AS requires_human_approval,
    pb.auto_merge AND coalesce(s.severity, 'SEV5') NOT IN ('SEV1', 'SEV2') AS auto_merge_when_green, pb.sla_minutes,
    coalesce(b.tier, 'low') AS tier,
    CASE WHEN coalesce(b.downstream_models, '') = '' THEN 0 ELSE len(string_split(b.downstream_models, ',')) END AS n_downstream,
    coalesce(b.n_exposures, 0) AS n_exposures, coalesce(l.n_events, 0) AS n_events, l.classes
  FROM kinds LEFT JOIN per_load l ON l.load_id = 'L2001.' || kind LEFT JOIN blast b ON b.load_id = 'L2001.' || kind
  LEFT JOIN severity s ON s.c = l.top_class AND s.tier = coalesce(b.tier, 'low')
  JOIN playbook pb ON pb.c = coalesce(l.top_class, 'no_drift'))"""


@query("route_decisions", f"WITH {DETECT}, {_GRAPH}, {_ROUTES} SELECT * EXCLUDE (classes, n_events) FROM decisions")
def route_decisions(g: Given):
    """The decisions rest on classes and columns, not on the confidence that re-sent rows add."""
    decisions, _ = g.decided(g.detection.events)
    return decisions.drop("table_fqn", "staging_models", "downstream_models", "exposures", "event_ids", "classes")


@query("scan_decisions", f"WITH {DETECT}, {_GRAPH}, {_ROUTES} SELECT * EXCLUDE (classes, n_events) FROM decisions")
def scan_decisions(g: Given):
    """The production scan, sketches and all, over a fresh control folder: the past loads become the baseline, then every variant is decided. The variants are
    alternatives of one load, so none becomes the baseline of another."""
    control = ControlPlane(g.spark, scratch_path(g.spark, "scan-control"))
    bootstrap(control, [WatchedTable(ORDERS, "order_id", [g.baseline])], datetime(2002, 1, 1))
    now = WatchedTable(ORDERS, "order_id", [g.baseline, *g.variants.values()])
    decisions = scan(control, [now], Lineage(g.column_map, *g.lineage, PROJECT), g.policy, datetime(2002, 1, 2), rolling=False)
    return decisions.drop("table_fqn", "staging_models", "downstream_models", "exposures", "event_ids", "classes")


_LOADS = """loads AS (SELECT DISTINCT _load_id AS load_id FROM bronze),
judged AS (SELECT load_id, load_id = 'L1999' AS bad FROM loads WHERE load_id > 'L1997')"""


@query("rolling_scan", f"""WITH {BRONZE}, {_LOADS},
pairs AS (
  SELECT j.load_id, j.bad, b.load_id AS base_load_id FROM judged j JOIN loads b ON b.load_id < j.load_id AND b.load_id <> 'L1999'
  QUALIFY row_number() OVER (PARTITION BY j.load_id ORDER BY b.load_id DESC) <= 7)
SELECT load_id, CASE WHEN bad THEN 'semantic' ELSE 'no_drift' END AS top_class, CASE WHEN bad THEN 'QUARANTINED' ELSE 'PASSED' END AS status,
       string_agg(base_load_id, ',' ORDER BY base_load_id) AS compared_with FROM pairs GROUP BY load_id, bad""")
def rolling_scan(g: Given):
    """Four loads that arrive together, the second of them in another unit: each is compared with the loads that pass before it, also with
    those of the same scan, and never with the one that does not pass."""
    control = ControlPlane(g.spark, scratch_path(g.spark, "rolling-control"))
    rows = g.orders.withColumn("amount", F.when(F.col("_load_id") == "L1999", F.round(F.col("amount") / 84, 2)).otherwise(F.col("amount")).cast("decimal(12,2)"))
    bootstrap(control, [WatchedTable(ORDERS, "order_id", [rows.where(F.col("_load_id") <= "L1997")])], datetime(2002, 1, 1))
    decisions = scan(control, [WatchedTable(ORDERS, "order_id", [rows])], Lineage(g.column_map, *g.lineage, PROJECT), g.policy, datetime(2002, 1, 2))
    status = gate_latest(control.read("gate_log")).select("load_id", "status")
    compared = control.read("comparisons").groupBy("load_id").agg(F.array_join(F.array_sort(F.collect_list("base_load_id")), ",").alias("compared_with"))
    return decisions.select("load_id", "top_class").join(status, "load_id").join(compared, "load_id")


@query("scan_trace", f"""WITH {BRONZE}, sizes AS (SELECT count(DISTINCT _load_id) AS loads, count(*) AS n FROM bronze WHERE _load_id >= 'L2000')
SELECT 'operational' AS surface, 'list new loads' AS step, CAST(loads AS BIGINT) AS "rows", CAST(NULL AS BIGINT) AS load_rows FROM sizes
UNION ALL SELECT 'operational', s, loads, n FROM sizes, (VALUES ('count their rows'), ('profile them')) t(s)
UNION ALL SELECT 'operational', 'round 0: detect', 0, NULL
UNION ALL SELECT 'operational', s, loads, NULL FROM sizes, (VALUES ('round 0: decide'), ('round 0: conclude')) t(s)
UNION ALL SELECT 'contextual', s, loads, NULL FROM sizes, (VALUES ('arrival'), ('baseline'), ('thresholds')) t(s)
UNION ALL SELECT 'cognitive', s, loads, NULL FROM sizes, (VALUES ('schema_diff'), ('top_class'), ('severity'), ('gate'), ('human_approval')) t(s)""")
def scan_trace(g: Given):
    """The three surfaces of the trace of a scan of two clean loads: what the run counted in each step, what each decision was made against, and how
    it was made. The rows that the profiles read are those that were counted before."""
    control = ControlPlane(g.spark, scratch_path(g.spark, "trace-control"))
    bootstrap(control, [WatchedTable(ORDERS, "order_id", [g.orders.where(F.col("_load_id") < "L2000")])], datetime(2002, 1, 1))
    scan(control, [WatchedTable(ORDERS, "order_id", [g.orders])], Lineage(g.column_map, *g.lineage, PROJECT), g.policy, datetime(2002, 1, 2))
    trace = control.read("decision_trace")
    counted = F.from_json("reasoning", "rows bigint, load_rows bigint")
    run = trace.where(F.col("surface") == "operational").select("surface", F.col("decision").alias("step"), counted.alias("c")).select("surface", "step", "c.*")
    others = trace.where(F.col("surface") != "operational").groupBy("surface", F.col("decision").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    return run.unionByName(others.withColumn("load_rows", F.lit(None).cast("bigint")))


@query("adoption_gate", f"""WITH {DETECT}, {_GRAPH}, {_ROUTES},
modes(mode) AS (VALUES ('observe'), ('advise'), ('protect')),
asked AS (SELECT *, CASE gate WHEN 'PASS' THEN 'PASSED' WHEN 'HOLD' THEN 'PENDING' ELSE 'QUARANTINED' END AS would FROM decisions, modes)
SELECT load_id, mode, incident_id, would AS playbook_status, CASE mode WHEN 'protect' THEN would ELSE 'PASSED' END AS status,
       mode <> 'protect' AND would <> 'PASSED' AS advisory,
       CASE WHEN top_class = 'no_drift' THEN 'diagnosis:clean' WHEN mode = 'protect' THEN 'diagnosis' ELSE 'diagnosis:' || mode END AS decided_by,
       gate IN ('HOLD', 'QUARANTINE') AND mode = 'protect' AS mitigated,
       fix_action NOT IN ('none', 'normalize_after_confirmation') AND mode <> 'observe' AS fix_proposed
FROM asked""")
def adoption_gate(g: Given):
    """What each adoption mode does with the same decisions."""
    decisions, _ = g.decided()
    parts = [routing.gate_requests(decisions, m).withColumn("mode", F.lit(m)) for m in ("observe", "advise", "protect")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("table_fqn")


_LABEL = "INR→USD (≈84 INR per USD)"
_REASONS = f"""reasons AS (
  SELECT e.*, CASE
    WHEN drift_class = 'rename' THEN 'CUSTOMER_KEY holds ' || f.c || ' of the values of CUST_ID; nulls agree to 1.0, distinct values to '
      || f.r || '; total ' || f.score
    WHEN e.subtype IN ('unit_change', 'scale_shift') THEN 'median moved from ' || round(n.med, 4) || ' to ' || round(n.m, 4) || ', factor '
      || round(n.ratio, 4) || ' at z ' || round(n.z, 1) || '; known change: '
      || CASE WHEN direction IS NULL THEN 'none' ELSE '{_LABEL}' END
    WHEN drift_class = 'semantic' THEN 'code shares moved by PSI ' || round(t.psi, 3) || '; shared codes ' || round(t.overlap, 3)
    WHEN e.subtype = 'column_dropped' THEN 'no ' || column_before || ' in this load; not its successor: '
      || (SELECT string_agg(r.column_after || ': ' || r.reason, ' | ' ORDER BY r.column_after) FROM rejected r
          WHERE r.load_id = e.load_id AND r.column_before = e.column_before)
    WHEN drift_class = 'additive' THEN column_after || ' of type ' || type_after || ' is new'
    ELSE column_before || ' was ' || type_before || ', now ' || type_after || ': widening' END AS reasoning,
    coalesce((SELECT string_agg(r.column_before || '→' || r.column_after || ': ' || r.reason, '; ' ORDER BY r.column_before, r.column_after)
      FROM rejected r WHERE r.load_id = e.load_id AND (r.column_before = e.column_before OR r.column_after = e.column_after)), '') AS alternatives,
    row_number() OVER (PARTITION BY e.load_id ORDER BY drift_class, coalesce(column_before, ''), coalesce(column_after, '')) AS pos,
    count(*) OVER (PARTITION BY e.load_id) AS n
  FROM events e CROSS JOIN fingerprint f
  LEFT JOIN numeric_tests n ON n.load_id = e.load_id AND n.column_name = e.column_before AND n.flagged
  LEFT JOIN category_tests t ON t.load_id = e.load_id AND t.column_name = e.column_before AND t.flagged)"""


@query("decision_trace", f"""WITH {DETECT}, {_GRAPH}, {_ROUTES}, {_REASONS},
summary(load_id, added, dropped, type_changed, unchanged) AS ({_SUMMARY})
SELECT d.incident_id, t.* FROM decisions d JOIN (
  SELECT load_id, 0 AS step, 'schema_diff' AS decision,
         'added=' || added || ' dropped=' || dropped || ' type_changed=' || type_changed AS choice,
         'schema of the last PASSED load against the schema of the new load' AS reasoning, '' AS alternatives, 'high' AS confidence
  FROM summary
  UNION ALL SELECT load_id, n - pos + 1, 'classify:' || coalesce(column_before, column_after), drift_class || '/' || subtype, reasoning,
         alternatives, CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END FROM reasons
  UNION ALL SELECT load_id, n_events + 1, 'top_class', top_class,
         'highest precedence among ' || coalesce(classes, 'none') || ' in the order breaking, semantic, rename, type_widening, additive', '', 'high' FROM decisions
  UNION ALL SELECT load_id, n_events + 2, 'severity', severity,
         'severity[' || top_class || '][' || tier || ']; ' || n_downstream || ' downstream models, ' || n_exposures || ' exposures', '', 'high' FROM decisions
  UNION ALL SELECT load_id, n_events + 3, 'gate', gate, 'playbook ' || route || ' for class ' || top_class,
         CASE gate WHEN 'PASS' THEN 'HOLD, QUARANTINE' WHEN 'HOLD' THEN 'PASS, QUARANTINE' ELSE 'PASS, HOLD' END, 'high' FROM decisions
  UNION ALL SELECT load_id, n_events + 4, 'human_approval', CAST(requires_human_approval AS VARCHAR),
         severity || CASE WHEN requires_human_approval THEN ' is' ELSE ' is not' END || ' among SEV1, SEV2', '', 'high' FROM decisions
) t USING (load_id)""")
def decision_trace(g: Given):
    decisions, _ = g.decided()
    trace = routing.decision_trace(decisions, g.events, diff_summary(_diff(g)), g.policy, g.scored.where(F.col("reason").isNotNull()))
    return trace.drop("table_fqn")


@query("incident_texts", f"""WITH {DETECT}, {_GRAPH}, {_ROUTES}, {_REASONS},
primary_event AS (SELECT r.* FROM reasons r JOIN decisions d ON d.load_id = r.load_id AND d.top_class = r.drift_class
                  QUALIFY row_number() OVER (PARTITION BY r.load_id ORDER BY pos) = 1)
SELECT d.load_id, d.incident_id,
  CASE d.severity WHEN 'SEV1' THEN '🔴' WHEN 'SEV2' THEN '🟠' WHEN 'SEV3' THEN '🟡' WHEN 'SEV4' THEN '🔵' ELSE '⚪' END || ' orders ' || d.severity || ', '
  || CASE d.top_class WHEN 'additive' THEN 'Additive (new column): ' || p.column_after WHEN 'rename' THEN 'Rename: CUST_ID now CUSTOMER_KEY'
       WHEN 'type_widening' THEN 'Type widening: AMOUNT now NUMBER(18,2)' WHEN 'breaking' THEN 'Breaking change: ' || p.column_before
       WHEN 'semantic' THEN 'Semantic drift: values of ' || p.column_before ELSE 'No drift' END AS headline,
  CASE WHEN d.top_class = 'no_drift' THEN '' ELSE 'For {OWNERS[ORDERS]}. '
  || CASE d.top_class WHEN 'rename' THEN 'CUST_ID arrives as CUSTOMER_KEY. Will it stay so?'
       WHEN 'semantic' THEN p.column_before || ' holds other values than before (' || CASE p.subtype WHEN 'unit_change' THEN '{_LABEL}'
         ELSE 'cause unknown' END || '). Which unit or coding is it in?'
       WHEN 'breaking' THEN p.column_before || ' is no longer sent. What takes its place, and can earlier loads be sent again?'
       WHEN 'type_widening' THEN 'AMOUNT arrives as NUMBER(18,2) instead of NUMBER(12,2). Tell us only if that is a mistake.'
       ELSE p.column_after || ' arrives for the first time. Should readers use it?' END
  || ' The load''s gate: ' || d.gate || '.' END AS producer_note
FROM decisions d LEFT JOIN primary_event p USING (load_id)""")
def incident_texts(g: Given):
    decisions, _ = g.decided()
    return routing.incident_texts(with_owner(decisions, g.registry), g.events).drop("table_fqn")


@query("determinism_check", f"WITH {DETECT} SELECT 'L2001.' || kind AS load_id, 0 AS differences FROM kinds")
def determinism_check(g: Given):
    """Two independent runs of the whole chain, the second over the rows in another arrangement."""
    first, _ = g.decided()
    again = Given(g.spark, g.sf_dir)
    # arranged once and stored: the steps of the second run read it in that order instead of shuffling all rows again in each
    again.__dict__["orders"] = write_through(g.orders.repartition("channel", "order_id"), "arranged-orders")
    nodes, edges = again.lineage
    second, _ = decide(again.candidates, again.events, again.column_map, nodes, edges, "shop", again.policy)
    return routing.determinism_differences(first, second).drop("table_fqn")
