"""Streaming forms, run to the end of what has arrived and compared with the batch result."""
from __future__ import annotations

from pyspark.sql import functions as F

from datetime import datetime

from loadwarden.catalog.given import ORDERS, PROJECT, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE
from loadwarden.functions.stats import psi_term
from loadwarden.operators.gate import gate_latest
from loadwarden.plans.scan import Lineage, WatchedTable, bootstrap
from loadwarden.session import scratch_path
from loadwarden.sources.control import ControlPlane
from loadwarden.streaming.closing import scan_closed
from loadwarden.streaming.drift import numeric_drift, window_sketches, with_ring
from loadwarden.streaming.watch import arrived_loads, file_stream, latest_versions, window_counts, write_windows


def _events(g: Given):
    # a file stream takes a folder or a glob; the class keeps the glob to the one table
    return file_stream(g.spark, f"{g.sf_dir}/event[s].parquet", g.table("events").schema)


@query("stream_latest_per_key", """SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_per_key(g: Given):
    return latest_versions(g.spark, _events(g), "user_id", ["ts", "event_id"], scratch_path(g.spark, "latest"))


_WINDOWS = """windows AS (
  SELECT 'E' || strftime(date_trunc('day', ts), '%Y%m%d%H%M') AS load_id, event_type AS category, count(*) AS n, count(value) AS n_value,
         sum(value) AS sum_value, min(value) AS min_value, max(value) AS max_value
  FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL)"""


def _windows(g: Given):
    counts = window_counts(_events(g), "ts", "event_type", "value", "1 day", "2 hours")
    return g.spark.read.parquet(write_windows(counts, scratch_path(g.spark, "windows")))


@query("stream_windows", f"""WITH {_WINDOWS}
SELECT load_id, category, n, n_value, round(sum_value, 4) AS sum_value, min_value, max_value FROM windows""")
def stream_windows(g: Given):
    """Closed daily windows of the event stream; the last day stays open behind the watermark."""
    return _windows(g).withColumn("sum_value", F.round("sum_value", 4))


@query("stream_drift_monitor", f"""WITH {_WINDOWS},
shares AS (SELECT load_id, category, n / sum(n) OVER (PARTITION BY load_id) AS share FROM windows),
ranked AS (SELECT load_id, row_number() OVER (ORDER BY load_id) AS pos FROM (SELECT DISTINCT load_id FROM shares)),
pairs AS (SELECT a.load_id, b.load_id AS base_load_id FROM ranked a JOIN ranked b ON b.pos BETWEEN a.pos - 7 AND a.pos - 1),
sizes AS (SELECT load_id, count(*) AS k FROM pairs GROUP BY 1 HAVING count(*) >= 3),
expected AS (SELECT p.load_id, s.category, sum(s.share) AS total FROM pairs p JOIN shares s ON s.load_id = p.base_load_id GROUP BY ALL),
joined AS (SELECT coalesce(e.load_id, s.load_id) AS load_id, e.total, s.share FROM expected e
           FULL JOIN shares s ON s.load_id = e.load_id AND s.category = e.category)
SELECT load_id, k AS baseline_windows, round(sum((greatest(coalesce(share, 0), 1e-4) - greatest(coalesce(total / k, 0), 1e-4))
   * ln(greatest(coalesce(share, 0), 1e-4) / greatest(coalesce(total / k, 0), 1e-4))), 6) AS psi
FROM joined JOIN sizes USING (load_id) GROUP BY ALL""")
def stream_drift_monitor(g: Given):
    """Share shift of each closed window against up to seven windows before it."""
    from pyspark.sql import Window

    counts = _windows(g)
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("load_id")))
    # one row per closed window: the list of windows is control data
    order = Window.orderBy("load_id")
    loads = shares.select("load_id").distinct().withColumn("pos", F.row_number().over(order))
    pairs = loads.select("load_id", F.explode(F.sequence(F.col("pos") - 7, F.col("pos") - 1)).alias("pos")).join(
        loads.withColumnRenamed("load_id", "base_load_id"), "pos").drop("pos")
    sizes = pairs.groupBy("load_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 3")
    base = pairs.join(shares.select(F.col("load_id").alias("base_load_id"), "category", "share"), "base_load_id").select(
        "load_id", "category", F.col("share").alias("base"), F.lit(None).cast("double").alias("new"))
    new = shares.select("load_id", "category", F.lit(None).cast("double").alias("base"), F.col("share").alias("new"))
    merged = base.unionByName(new).groupBy("load_id", "category").agg(F.sum("base").alias("base"), F.max("new").alias("new"))
    return merged.join(sizes, "load_id").groupBy("load_id", F.col("k").alias("baseline_windows")).agg(
        F.round(F.sum(psi_term(F.col("base") / F.col("k"), F.col("new"))), 6).alias("psi"))


@query("stream_scan", """SELECT 'lake.raw.events' AS table_fqn, 'E' || strftime(ts, '%Y%m%d') AS load_id, count(*) AS row_count,
  'PENDING' AS status FROM events GROUP BY ALL""")
def stream_scan(g: Given):
    """A watched folder whose loads arrive in pieces over several micro-batches: each batch adds to the counts of its loads, and what has
    arrived is then held. The run is repeated to show that a load which has a gate row is not new."""
    root = scratch_path(g.spark, "stream-scan")
    control = ControlPlane(g.spark, f"{root}/control")
    events = g.table("events")
    events.repartition(3, "event_id").write.parquet(f"{root}/arriving")  # every load is in every file
    for run in ("first", "again"):
        arriving = file_stream(g.spark, f"{root}/arriving", events.schema, max_files=1)
        loads = arrived_loads(g.spark, arriving, F.concat(F.lit("E"), F.date_format("ts", "yyyyMMdd")), "ts", f"{root}/{run}")
        fresh = loads.withColumn("table_fqn", F.lit("lake.raw.events")).join(
            gate_latest(control.read("gate_log")).select("table_fqn", "load_id"), ["table_fqn", "load_id"], "left_anti")
        control.append("gate_log", fresh.select("table_fqn", "load_id", "row_count", F.col("last_at").alias("decided_at"), F.lit(0).alias("seq"),
                                                F.lit("PENDING").alias("status"), F.lit(None).alias("incident_id"), F.lit("watch").alias("decided_by"),
                                                F.lit(False).alias("approved")))
    return gate_latest(control.read("gate_log")).select("table_fqn", "load_id", "row_count", "status")


@query("stream_decisions", f"""WITH {BRONZE}
SELECT _load_id AS load_id, count(*) AS row_count, CASE WHEN _load_id = 'L2000' THEN 'QUARANTINED' WHEN _load_id = 'L2001' THEN 'not closed' ELSE 'PASSED' END AS status,
       CASE WHEN _load_id = 'L2000' THEN 'unit_change' END AS subtype
FROM bronze WHERE _load_id >= 'L1999' GROUP BY 1""")
def stream_decisions(g: Given):
    """Three loads that come in pieces over several micro-batches, with a restart in between: each is scanned when its timer has run out, against the loads that
    passed before it. One comes in another unit; the last stays open, as nothing later has come."""
    root = scratch_path(g.spark, "stream-decisions")
    control = ControlPlane(g.spark, f"{root}/control")
    amount = F.when(F.col("_load_id") == "L2000", F.round(F.col("amount") / 84, 2)).otherwise(F.col("amount")).cast("decimal(12,2)")
    rows = g.orders.withColumn("amount", amount)
    rows.where(F.col("_load_id") < "L1999").write.parquet(f"{root}/bronze")
    schema = g.spark.read.parquet(f"{root}/bronze").schema

    def watched():
        return WatchedTable(ORDERS, "order_id", [g.spark.read.schema(schema).parquet(f"{root}/bronze")])

    bootstrap(control, [watched()], datetime(2002, 1, 1))
    late = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 1
    pieces = [[("L1999", None)], [("L2000", False)], [("L2000", True), ("L2001", None)]]
    for run in (pieces[:2], pieces[2:]):
        for piece in run:
            for load, half in piece:
                some = rows.where(F.col("_load_id") == load)
                (some if half is None else some.where(late == half)).coalesce(1).write.mode("append").parquet(f"{root}/bronze")
        stream = file_stream(g.spark, f"{root}/bronze", schema, max_files=4)
        scan_closed(g.spark, stream, F.col("_load_id"), "_loaded_at", watched(), control, Lineage(g.column_map, *g.lineage, PROJECT), g.policy, root,
                    datetime(2002, 1, 2), "30 days", "1 day")
    sizes = watched().parts[0].groupBy(F.col("_load_id").alias("load_id")).agg(F.count(F.lit(1)).alias("row_count")).where("load_id >= 'L1999'")
    gate = gate_latest(control.read("gate_log")).select("load_id", "status", F.col("row_count").alias("_scanned"))
    events = control.read("drift_events").select("load_id", "subtype")
    # where the scan has decided a load, it saw all of its rows
    return sizes.join(gate, "load_id", "left").join(events, "load_id", "left").select(
        "load_id", F.coalesce("_scanned", "row_count").alias("row_count"), F.coalesce("status", F.lit("not closed")).alias("status"), "subtype")


_MOVED = "event_type = 'purchase' AND date_trunc('day', ts) = TIMESTAMP '2024-01-12'"


@query("stream_numeric_drift", f"""WITH moved AS (SELECT event_type, date_trunc('day', ts) AS day, value * CASE WHEN {_MOVED} THEN 100 ELSE 1 END AS v FROM events),
windows AS (
  SELECT day, event_type, count(*) AS n, quantile_disc(v, 0.5) AS med FROM moved
  WHERE v IS NOT NULL AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS pos FROM windows),
base AS (
  SELECT a.event_type, a.day, a.n, a.med, count(*) AS k, median(b.med) AS base, list(b.med) AS meds
  FROM ranked a JOIN ranked b ON b.event_type = a.event_type AND b.pos BETWEEN a.pos - 7 AND a.pos - 1 GROUP BY ALL HAVING count(*) >= 3),
tested AS (SELECT *, list_median(list_transform(meds, lambda m: abs(m - base))) AS mad FROM base)
SELECT 'E' || strftime(day, '%Y%m%d') AS load_id, event_type AS "column", n, k AS baseline_windows,
       greatest(base / med, med / base) >= 3 AND abs(med - base) / (1.4826 * CASE WHEN mad <> 0 THEN mad ELSE abs(base) * 0.01 END) >= 6 AS flagged,
       true AS median_close, true AS pooled_close
FROM tested""")
def stream_numeric_drift(g: Given):
    """Every closed daily window of each kind of event against the ring of up to seven windows before it; one window comes in another unit. Medians come from
    sketches: they must lie between the exact values of the ranks 0.5 - 0.04 and 0.5 + 0.04, three times the sketch's guaranteed error."""
    from pyspark.sql import Window

    moved = F.expr(_MOVED)
    events = _events(g).withColumn("value", F.when(moved, F.col("value") * 100).otherwise(F.col("value")))
    root = scratch_path(g.spark, "numeric-drift")
    rings = with_ring(window_sketches(events, "ts", "event_type", "value", "1 day", "2 hours"))
    found = numeric_drift(g.spark.read.schema(rings.schema).parquet(write_windows(rings, root)), g.policy.thresholds)
    exact = g.table("events").withColumn("value", F.when(moved, F.col("value") * 100).otherwise(F.col("value"))).where("value IS NOT NULL").select(
        F.col("event_type").alias("column"), F.date_trunc("day", "ts").alias("start"), "value")
    ranked = exact.withColumn("_r", F.percent_rank().over(Window.partitionBy("column", "start").orderBy("value")))
    bounds = ranked.groupBy("column", "start").agg(F.max(F.when(F.col("_r") <= 0.46, F.col("value"))).alias("low"), F.min(F.when(F.col("_r") >= 0.54, F.col("value"))).alias("high"))
    spread = bounds.groupBy("column").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    start = F.date_format("start", "yyyyMMdd")
    return (found.withColumn("start", F.col("start").cast("timestamp_ntz")).join(bounds.withColumn("start", F.col("start").cast("timestamp_ntz")), ["column", "start"])
            .join(spread, "column").select(
                F.concat(F.lit("E"), start).alias("load_id"), "column", "n", F.col("baseline_windows").cast("bigint").alias("baseline_windows"), "flagged",
                F.col("median").between(F.col("low"), F.col("high")).alias("median_close"), F.col("pooled_median").between(F.col("least"), F.col("most")).alias("pooled_close")))
