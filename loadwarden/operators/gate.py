"""The load gate: an append-only request log, the state it leads to, and the filters built on it."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GATE_LOG_SCHEMA = ("seq bigint, table_fqn string, load_id string, status string, incident_id string, "
                   "decided_by string, decided_at timestamp_ntz, row_count bigint, approved boolean")
KEYS = ["table_fqn", "load_id"]
STATUSES = ("PENDING", "PASSED", "QUARANTINED")
# The span of seq of a log is cut into this many buckets; the requests of a load within one are ordered in one task.
SEQ_BUCKETS = 256
#: Steps of one run that write requests: watch, decision, release, put back.
STEPS = 8


def request_order(at: datetime, step: int) -> int:
    """Place of a request among those of its load: by instant, then by the step inside the run. The key of a request is (table, load, seq)."""
    return int(at.timestamp() * 1_000_000) * STEPS + step


def _positions() -> dict:
    """Where the requests sit that decide a state: quarantines, passes, approved passes."""
    q, p = F.col("status") == "QUARANTINED", F.col("status") == "PASSED"
    approved = F.coalesce(F.col("approved"), F.lit(False))
    return {"_q": F.when(q, F.col("seq")), "_p": F.when(p, F.col("seq")), "_ap": F.when(p & approved, F.col("seq"))}


def _state(q, p, ap):
    """State after requests with these last positions (q, ap) and this presence of a pass (p).

    A quarantine is always legal and only an approved pass leads out of it; without one, any pass decides.
    """
    return (F.when(q.isNotNull(), F.when(ap > q, "PASSED").otherwise("QUARANTINED"))
            .when(p.isNotNull(), "PASSED").otherwise("PENDING"))


def gate_latest(log: DataFrame) -> DataFrame:
    """Current gate row per (table, load) of a log of accepted requests (see `accepted`).

    Partial aggregates alone, no ordered pass over a load: the incident is the last one named, the row count the
    one of the first request.
    """
    audited = log.select("*", *[c.alias(n) for n, c in _positions().items()])
    agg = audited.groupBy(*KEYS).agg(
        F.max("_q").alias("_q"), F.min("_p").alias("_p"), F.max("_ap").alias("_ap"),
        F.max_by("incident_id", F.when(F.col("incident_id").isNotNull(), F.col("seq"))).alias("incident_id"),
        F.min_by("row_count", "seq").alias("row_count"), F.min("decided_at").alias("first_seen_at"),
        F.max_by("decided_by", "seq").alias("decided_by"), F.max("decided_at").alias("decided_at"))
    return agg.select(*KEYS, "row_count", _state(F.col("_q"), F.col("_p"), F.col("_ap")).alias("status"),
                      "incident_id", "decided_by", "decided_at", "first_seen_at")


def gate_audit(log: DataFrame) -> DataFrame:
    """Every request with the state before it and whether the transition is legal.

    The running positions are found in two steps, over buckets of the log and then inside a bucket, so that
    a load with very many requests is spread over tasks.
    """
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = ((high or 0) - (low or 0)) // SEQ_BUCKETS + 1
    rows = log.select("*", *[c.alias(n) for n, c in _positions().items()],
                      F.floor((F.col("seq") - F.lit(low or 0)) / F.lit(width)).alias("_bucket"))
    per_bucket = rows.groupBy(*KEYS, "_bucket").agg(F.max("_q").alias("_bq"), F.max("_p").alias("_bp"),
                                                    F.max("_ap").alias("_bap"))
    earlier = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*KEYS, "_bucket", *[F.max(c).over(earlier).alias(c) for c in ("_bq", "_bp", "_bap")])
    inside = (Window.partitionBy(*KEYS, "_bucket").orderBy("seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.join(carried, [*KEYS, "_bucket"])
    before = {n: F.greatest(F.max(n).over(inside), F.col(b)) for n, b in (("_q", "_bq"), ("_p", "_bp"), ("_ap", "_bap"))}
    stated = seen.select(*log.columns, _state(before["_q"], before["_p"], before["_ap"]).alias("current"))
    approved = F.coalesce(F.col("approved"), F.lit(False))
    legal = (
        (F.col("current") == "PENDING")
        | ((F.col("current") == "PASSED") & F.col("status").isin("PASSED", "QUARANTINED"))
        | ((F.col("current") == "QUARANTINED") & ((F.col("status") == "QUARANTINED")
                                                  | ((F.col("status") == "PASSED") & approved))))
    return stated.withColumn("legal", legal)


def accepted(log: DataFrame) -> DataFrame:
    """The requests that took effect; an illegal one changes nothing."""
    return gate_audit(log).where("legal").select(*log.columns)


def require_legal(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests, failing the job when one of them is illegal against the log."""
    concerned = log.join(requests.select(*KEYS).distinct(), KEYS, "left_semi")
    checked = gate_audit(concerned.unionByName(requests)).join(requests.select(*KEYS, "seq"), [*KEYS, "seq"], "left_semi")
    message = F.concat(F.lit("illegal load-gate transition "), "current", F.lit(" to "), "status", F.lit(" for "),
                       "table_fqn", F.lit("/"), "load_id")
    return checked.where(F.when(F.col("legal"), True).otherwise(F.raise_error(message).cast("boolean"))).select(
        *requests.columns)


def passed_loads(gate: DataFrame) -> DataFrame:
    return gate.where(F.col("status") == "PASSED").select(*KEYS)


def gated(bronze: DataFrame, table: str, passed: DataFrame) -> DataFrame:
    """Rows of PASSED loads only. A semi join without a hint: Spark broadcasts the load list while it is small
    and prunes partitions with it, and falls back to a shuffled join when it is not."""
    loads = passed.where(F.col("table_fqn") == table).select(F.col("load_id").alias("_load_id"))
    return bronze.join(loads, "_load_id", "left_semi")


def new_loads(observed: DataFrame, gate: DataFrame) -> DataFrame:
    """Loads present in bronze that no gate row knows yet."""
    return observed.join(gate.select(*KEYS), KEYS, "left_anti")


def baseline_loads(gate: DataFrame, candidates: DataFrame, n: int = 7) -> DataFrame:
    """For each candidate load: the last n PASSED loads of its table, newest first (rank 1), itself left out."""
    newest = Window.partitionBy("table_fqn").orderBy(F.desc("load_id"))
    recent = (passed_loads(gate).withColumn("base_rank", F.row_number().over(newest))
              .where(F.col("base_rank") <= n).withColumnRenamed("load_id", "base_load_id"))
    return (candidates.select(*KEYS).join(recent, "table_fqn")
            .where(F.col("base_load_id") != F.col("load_id")).select(*KEYS, "base_load_id", "base_rank"))


def last_passed_snapshot(snapshots: DataFrame, gate: DataFrame, candidates: DataFrame) -> DataFrame:
    """The snapshot each candidate is compared with: the newest PASSED one of its table, or, where nothing has
    passed, the newest one before the candidate itself."""
    ids = snapshots.select("table_fqn", "snapshot_id").distinct()
    passed = (ids.join(passed_loads(gate).withColumnRenamed("load_id", "snapshot_id"), ["table_fqn", "snapshot_id"],
                       "left_semi")
              .groupBy("table_fqn").agg(F.max("snapshot_id").alias("_passed")))
    order = Window.partitionBy("table_fqn").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ids.select("table_fqn", F.col("snapshot_id").alias("load_id"),
                         F.max("snapshot_id").over(order).alias("_earlier"))
    return (candidates.select(*KEYS).join(passed, "table_fqn", "left").join(earlier, KEYS, "left")
            .select(*KEYS, F.coalesce("_passed", "_earlier").alias("before_id")))


def rolling_baseline(gate: DataFrame, ranked: DataFrame, n: int = 7) -> DataFrame:
    """For each load of `ranked` (table_fqn, load_id, rank: its place among the new loads of its table): the last n loads it is to be compared with, newest
    first, out of the PASSED ones and the new loads before it, as if those had passed.

    A load meets n passed and n new loads at most, so the ranking stays as small as the list of loads.
    """
    newest = Window.partitionBy("table_fqn").orderBy(F.desc("load_id"))
    passed = (passed_loads(gate).join(ranked.select(*KEYS), KEYS, "left_anti").withColumn("_newest", F.row_number().over(newest))
              .where(F.col("_newest") <= n).select("table_fqn", F.col("load_id").alias("base_load_id")))
    before = ranked.select(*KEYS, F.explode(F.sequence(F.greatest(F.lit(1), F.col("rank") - n), F.col("rank"))).alias("rank")).join(
        ranked.select("table_fqn", F.col("load_id").alias("base_load_id"), "rank"), ["table_fqn", "rank"]).where("base_load_id <> load_id")
    pool = ranked.select(*KEYS).join(passed, "table_fqn").unionByName(before.select(*KEYS, "base_load_id"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("base_load_id"))
    return pool.withColumn("base_rank", F.row_number().over(order)).where(F.col("base_rank") <= n)


def rolling_snapshot(snapshots: DataFrame, gate: DataFrame, ranked: DataFrame) -> DataFrame:
    """The snapshot each load of `ranked` is compared with when the new loads before it are taken as passed: the newest of those and of the PASSED ones, or, where
    there is none, the newest one before the load itself."""
    as_before = last_passed_snapshot(snapshots, gate, ranked)
    previous = ranked.select("table_fqn", F.col("load_id").alias("_previous"), (F.col("rank") + 1).alias("rank"))
    passed = passed_loads(gate).join(ranked.select(*KEYS), KEYS, "left_anti").join(
        snapshots.select("table_fqn", F.col("snapshot_id").alias("load_id")).distinct(), KEYS, "left_semi").groupBy("table_fqn").agg(F.max("load_id").alias("_passed"))
    return (ranked.join(previous, ["table_fqn", "rank"], "left").join(passed, "table_fqn", "left").join(as_before, KEYS)
            .select(*KEYS, F.coalesce(F.greatest("_previous", "_passed"), "before_id").alias("before_id")))


def gate_listing(gate: DataFrame, limit: int = 200) -> DataFrame:
    """Newest loads of each table first; the limit is the page size of the listing."""
    return gate.orderBy("table_fqn", F.desc("load_id")).limit(limit)
