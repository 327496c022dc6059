"""Scan and bootstrap: what happens to loads that no gate row knows yet, written to the control plane."""
from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loadwarden.operators.classify import FIELDS, RESCALED, with_restatement
from loadwarden.operators.gate import GATE_LOG_SCHEMA, gate_latest, new_loads, passed_loads, request_order, require_legal
from loadwarden.operators.incidents import incident_entries
from loadwarden.operators.profile import long_values, sketch_profile, value_counts
from loadwarden.operators.rename import exact_containment, scored_pairs
from loadwarden.operators.routing import decision_trace, gate_requests
from loadwarden.operators.schema_diff import diff_summary
from loadwarden.operators.semantic import restatement
from loadwarden.operators.sketches import pair_theta_containment
from loadwarden.plans.detect import Inputs, decide, detect, structure
from loadwarden.policy import Policy
from loadwarden.session import write_through
from loadwarden.sources.bronze import observed_loads, schema_snapshots
from loadwarden.sources.control import ControlPlane, preserve_evidence

# Who holds a load between its arrival and its decision.
WATCH = "watch"
#: Rename scores this close to the threshold are settled by exact counts: three standard errors of a containment from sketches, as weighted.
NEAR = 0.03
KEYS = ["table_fqn", "load_id"]


@dataclass
class WatchedTable:
    """A bronze table: one DataFrame per schema it has had, each holding any number of loads of that schema.

    The plan of a scan grows with the number of schemas, not with the number of loads.
    """
    table: str
    key: str | None
    parts: list[DataFrame]

    def rows_of(self, loads: DataFrame) -> list[tuple[int, DataFrame]]:
        """(part number, rows) of the given loads; a semi join on the load id, so partitions are pruned by it."""
        ids = loads.where(F.col("table_fqn") == self.table).select(F.col("load_id").alias("_load_id"))
        return [(i, p.join(ids, "_load_id", "left_semi")) for i, p in enumerate(self.parts)]


@dataclass
class Lineage:
    column_map: DataFrame
    nodes: DataFrame
    edges: DataFrame
    project: str


class Steps:
    """What a run did and how long it took: one row per step, with what was counted while its result was written."""

    def __init__(self, at: datetime):
        self.run_id = f"RUN-{int(at.timestamp() * 1_000_000)}"
        self.rows: list[tuple[int, str, float, str]] = []

    @contextmanager
    def __call__(self, name: str):
        counted: dict[str, int] = {}
        start = time.perf_counter()
        yield counted
        took = time.perf_counter() - start
        self.rows.append((len(self.rows), name, round(took, 3), json.dumps(counted, sort_keys=True)))

    def trace(self, spark) -> DataFrame:
        rows = spark.createDataFrame(self.rows, "step int, decision string, seconds double, reasoning string")
        return rows.select(F.lit("operational").alias("surface"), F.lit(self.run_id).alias("run_id"), F.lit(None).cast("string").alias("incident_id"), "step", "decision",
                           F.concat(F.col("seconds").cast("string"), F.lit(" s")).alias("choice"), "reasoning",
                           F.array().cast("array<string>").alias("alternatives"), F.lit("measured").alias("confidence"))


def _counting(df: DataFrame, counted: dict, name: str, **sums) -> DataFrame:
    """Writes `df` and notes rows and sums of it as they pass by, without another pass."""
    seen = Observation()
    out = write_through(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()]), name)
    counted.update({k: v or 0 for k, v in seen.get.items()})
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _requests(spark, rows: DataFrame, at: datetime, step: int) -> DataFrame:
    """Gate requests of one instant; the running number follows the instant and the step inside a run.

    Rows of one step concern different loads, so one number serves them all: it only orders the requests of a load.
    """
    typed = spark.createDataFrame([], GATE_LOG_SCHEMA)
    numbered = rows.withColumns({
        "seq": F.lit(request_order(at, step)),
        "decided_at": F.lit(at).cast("timestamp_ntz"), "approved": F.lit(False)})
    missing = {c: F.lit(None) for c in ("row_count", "incident_id") if c not in numbered.columns}
    return numbered.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in typed.schema.fields])


def _discover(control: ControlPlane, tables: list[WatchedTable], steps: Steps, only: DataFrame | None = None) -> DataFrame:
    """New loads of all tables, and those an interrupted scan has left undecided, with the part that holds them."""
    present = _union([p.select(F.lit(t.table).alias("table_fqn"), F.col("_load_id").alias("load_id")).distinct().withColumn("part", F.lit(i))
                      for t in tables for i, p in enumerate(t.parts)])
    if only is not None:
        present = present.join(only.select(*KEYS), KEYS, "left_semi")
    gate = gate_latest(control.read("gate_log"))
    decided = gate.where((F.col("status") != "PENDING") | (F.col("decided_by") != WATCH))
    with steps("list new loads") as n:
        fresh = _counting(new_loads(present, decided), n, "fresh-loads")
    parts = _parts_in(fresh)
    if not parts:
        return fresh.select("table_fqn", "load_id", F.lit(None).cast("bigint").alias("row_count"),
                            F.lit(None).cast("timestamp_ntz").alias("loaded_at"), "part")
    # rows are counted in the new loads alone: the load id prunes the partitions
    counted = _union([observed_loads(df, t.table).withColumn("part", F.lit(i)) for t in tables for i, df in t.rows_of(fresh)
                      if (t.table, i) in parts])
    with steps("count their rows") as n:
        return _counting(counted, n, "new-loads", load_rows="row_count")


def _parts_in(fresh: DataFrame) -> set[tuple[str, int]]:
    """Which schemas of which tables have new loads: as many entries as there are schemas."""
    return {(r["table_fqn"], r["part"]) for r in fresh.select("table_fqn", "part").distinct().collect()}


def _observe(control: ControlPlane, tables: list[WatchedTable], fresh: DataFrame, parts: set[tuple[str, int]]) -> None:
    """Write snapshots and profiles of the new loads: one pass over each, in which only sketch states move. Distinct counts, quantiles, top
    values and the sketches that containment is taken from later are stored; a load is not read again for them."""
    schemas = {(t.table, str(i)): p.schema for t in tables for i, p in enumerate(t.parts) if (t.table, i) in parts}
    columns = schema_snapshots(control.spark, schemas).withColumn("part", F.col("snapshot_id").cast("int")).drop("snapshot_id")
    control.replace("schema_snapshots", columns.join(
        fresh.select("table_fqn", "part", F.col("load_id").alias("snapshot_id")), ["table_fqn", "part"]))
    control.replace("column_profiles", _union([sketch_profile(df, t.table) for t in tables for i, df in t.rows_of(fresh) if (t.table, i) in parts]))


def _containment(tables: list[WatchedTable], fresh: DataFrame, known: tuple[DataFrame, DataFrame], profiles: DataFrame, policy: Policy) -> DataFrame:
    """Containment of every pair of a dropped and an added column of one family, from the stored sketches. Pairs whose score comes within
    the sketches' error of the threshold are counted exactly, over their columns alone."""
    baseline, diff = known
    side = {k: diff.where(F.col("change") == k).select("table_fqn", "load_id", F.col("family"), f"column_{c}")
            for k, c in (("dropped", "before"), ("added", "after"))}
    pairs = side["dropped"].join(side["added"], ["table_fqn", "load_id", "family"]).drop("family")
    estimated = write_through(pair_theta_containment(pairs, baseline, profiles), "containment")
    limits = policy.thresholds
    scored = scored_pairs(diff, profiles, baseline, estimated, limits)
    near = scored.where(F.abs(F.col("score") - limits["rename_min_score"]) <= NEAR).select("table_fqn", "column_before", "column_after").distinct()
    wanted: dict[str, set[str]] = {}
    for r in near.collect():  # column names, bounded by the width of the tables
        wanted.setdefault(r["table_fqn"], set()).update(c.upper() for c in r[1:])
    loads = baseline.select("table_fqn", F.col("base_load_id").alias("load_id")).union(fresh.select("table_fqn", "load_id")).distinct()
    again = [long_values(df, t.table, columns=wanted[t.table]) for t in tables if t.table in wanted
             for _, df in t.rows_of(loads) if wanted[t.table] & {c.upper() for c in df.columns}]
    if not again:
        return estimated
    keys = ["table_fqn", "load_id", "column_before", "column_after"]
    exact = exact_containment(diff, baseline, value_counts(_union(again))).select(*keys, F.col("containment").alias("_exact"))
    return estimated.join(exact, keys, "left").select(*keys, F.coalesce("_exact", "containment").alias("containment"))


def bootstrap(control: ControlPlane, tables: list[WatchedTable], at: datetime) -> int:
    """First run: every load present becomes the PASSED baseline. Returns the number of loads."""
    fresh = _discover(control, tables, Steps(at))
    parts = _parts_in(fresh)
    if not parts:
        return 0
    _observe(control, tables, fresh, parts)
    rows = fresh.select("table_fqn", "load_id", "row_count", F.lit("PASSED").alias("status"),
                        F.lit("watch:bootstrap").alias("decided_by"))
    control.append("gate_log", _requests(control.spark, rows, at, 0))
    return fresh.count()


def scan(control: ControlPlane, tables: list[WatchedTable], lineage: Lineage, policy: Policy, at: datetime,
         mode: str = "protect", only: DataFrame | None = None, rolling: bool = True) -> DataFrame:
    """Snapshot, hold, profile, classify, route and gate every new load; returns the decisions. `only` (table_fqn, load_id) leaves other new loads for later.

    Loads that arrive together are decided as if they had come one by one: a load that passes joins the baseline of the next. For that, every load is first judged as
    if the new ones before it passed. That holds up to the first load of a table that does not pass, so these decisions are final, and the loads behind it are judged
    again in the next round. There are as many rounds as loads that do not pass, whatever the number of loads, and a round works on the stored schemas and sketches
    of all tables at once. With `rolling` off every load is compared with the baseline from before the scan, for loads that are alternatives of one another.

    Running it again is a no-op for decided loads. A scan that was interrupted is taken up again: snapshots and
    profiles are replaced, events, incidents and trace rows are inserted once.
    """
    steps = Steps(at)
    fresh = _discover(control, tables, steps, only)
    parts = _parts_in(fresh)
    left = fresh.select("table_fqn", "load_id").distinct()
    if not parts:
        return left
    with steps("profile them") as n:
        _observe(control, tables, fresh, parts)
        # what the profiles have read, which must be what was counted
        read = control.profiles(left).groupBy(*KEYS).agg(F.max("row_count").alias("row_count")).agg(F.count(F.lit(1)), F.sum("row_count")).first()
        n.update(rows=read[0], load_rows=read[1] or 0)
    held = fresh.select("table_fqn", "load_id", "row_count", F.lit("PENDING").alias("status"), F.lit(WATCH).alias("decided_by"))
    control.append("gate_log", _requests(control.spark, held, at, 0))
    arrival = Window.partitionBy("table_fqn").orderBy("load_id")
    decided = []
    while True:
        ranked = write_through(left.withColumn("rank", F.row_number().over(arrival)), "ranked-loads") if rolling else left
        decided.append(_round(control, tables, lineage, policy, at, mode, ranked, steps, len(decided)))
        left = left.join(decided[-1].select("table_fqn", "load_id"), ["table_fqn", "load_id"], "left_anti")
        if not rolling or left.isEmpty():
            break
    control.insert_absent("decision_trace", steps.trace(control.spark), ["surface", "run_id", "step"])
    return _union(decided)


def _round(control: ControlPlane, tables: list[WatchedTable], lineage: Lineage, policy: Policy, at: datetime, mode: str, candidates: DataFrame,
           steps: Steps, number: int) -> DataFrame:
    """Decides the candidates whose decision is final in this round (all of them without a `rank`) and writes what was found; returns their decisions."""
    spark = control.spark
    gate = write_through(gate_latest(control.read("gate_log")), "gate")
    known = structure(candidates, gate, control.read("schema_snapshots"), policy)
    base = known[0].select("table_fqn", F.col("base_load_id").alias("load_id")).distinct()
    profiles = write_through(control.profiles(base.union(candidates.select("table_fqn", "load_id"))), "profiles")
    inputs = Inputs(candidates, gate, control.read("schema_snapshots"), profiles,
                    containment=_containment(tables, candidates, known, profiles, policy),
                    key_columns=spark.createDataFrame([(t.table, t.key) for t in tables if t.key],
                                                      "table_fqn string, key_column string"))
    with steps(f"round {number}: detect") as n:
        found = detect(inputs, policy, known)
        events = _counting(found.events, n, "events")
    with steps(f"round {number}: decide") as n:
        decisions, _ = decide(candidates, events, lineage.column_map, lineage.nodes, lineage.edges, lineage.project, policy)
        decisions = _counting(decisions, n, "decisions")
    asked = gate_requests(decisions, mode)
    earlier = passed_loads(gate)
    if "rank" in candidates.columns:
        # a rescaled column ends a round too, as its evidence is taken from the rows accepted before it
        ends = asked.where(F.col("status") != "PASSED").select(*KEYS).union(events.where(RESCALED).select(*KEYS)).distinct()
        stop = candidates.join(ends, KEYS).groupBy("table_fqn").agg(F.min("rank").alias("stop"))
        final = write_through(candidates.join(stop, "table_fqn", "left").where("stop IS NULL OR rank <= stop").select(*KEYS, "stop", "rank"), "final-loads")
        decisions, events, asked = (write_through(df.join(final.select(*KEYS), KEYS, "left_semi").select(*df.columns), "final") for df in (decisions, events, asked))
        earlier = earlier.union(final.where("stop IS NULL OR rank < stop").select(*KEYS)).distinct()
    restated = _restated(tables, events, earlier)
    if restated is not None:
        events = write_through(with_restatement(events, restated), "events")
    judged = decisions.select(*KEYS)
    control.insert_absent("comparisons", known[0].join(judged, KEYS, "left_semi"), [*KEYS, "base_load_id"])
    _keep_evidence(control, tables, decisions, known[0])
    incident = F.when(F.col("decided_by").endswith(":clean"), F.lit(None)).otherwise(F.col("incident_id"))
    rows = asked.withColumn("incident_id", incident)
    requests = write_through(require_legal(control.read("gate_log"), _requests(spark, rows, at, 1)), "requests")
    flat = events.join(decisions.select("table_fqn", "load_id", "incident_id"), ["table_fqn", "load_id"]).select(
        "event_id", "incident_id", *FIELDS, F.to_json("evidence").alias("evidence"))
    control.insert_absent("drift_events", flat, ["event_id"])
    control.insert_absent("incident_log", incident_entries(decisions, asked, at), ["incident_id", "status"])
    with steps(f"round {number}: conclude") as n:
        n["rows"] = judged.count()
    trace = decision_trace(decisions, events, diff_summary(found.diff), policy, found.scored.where(F.col("reason").isNotNull()))
    control.insert_absent("decision_trace", trace.select(
        F.lit("cognitive").alias("surface"), F.lit(steps.run_id).alias("run_id"), "incident_id", "step", "decision", "choice", "reasoning",
        F.array("alternatives").alias("alternatives"), "confidence"), ["surface", "incident_id", "step"])
    control.insert_absent("decision_trace", _context(decisions, known[0], policy, steps.run_id, candidates), ["surface", "incident_id", "step"])
    # last: until its decision is in the gate log, a load counts as undecided and the next scan takes it up again
    control.append("gate_log", requests)
    return decisions


def _context(decisions: DataFrame, baseline: DataFrame, policy: Policy, run_id: str, candidates: DataFrame) -> DataFrame:
    """What each decision was made against: the loads compared with, the place among the loads that came together, and the thresholds in force."""
    against = baseline.groupBy(*KEYS).agg(F.array_sort(F.collect_list("base_load_id")).alias("_loads"))
    limits = json.dumps({k: v for k, v in sorted(policy.thresholds.items()) if isinstance(v, int | float)}, sort_keys=True)
    place = candidates.select(*KEYS, (F.col("rank") if "rank" in candidates.columns else F.lit(1)).alias("_place"))
    rows = decisions.select(*KEYS, "incident_id").join(against, KEYS, "left").join(place, KEYS)
    entries = F.inline(F.array(
        F.struct(F.lit(0).alias("step"), F.lit("baseline").alias("decision"), F.concat(F.coalesce(F.size("_loads"), F.lit(0)).cast("string"), F.lit(" loads")).alias("choice"),
                 F.coalesce(F.array_join("_loads", ", "), F.lit("")).alias("reasoning")),
        F.struct(F.lit(1).alias("step"), F.lit("arrival").alias("decision"), F.col("_place").cast("string").alias("choice"), F.lit("place among the loads judged together").alias("reasoning")),
        F.struct(F.lit(2).alias("step"), F.lit("thresholds").alias("decision"), F.lit("policy").alias("choice"), F.lit(limits).alias("reasoning"))))
    return rows.select("incident_id", entries).select(F.lit("contextual").alias("surface"), F.lit(run_id).alias("run_id"), "incident_id", "step", "decision", "choice", "reasoning",
                                                      F.array().cast("array<string>").alias("alternatives"), F.lit("recorded").alias("confidence"))


def _keep_evidence(control: ControlPlane, tables: list[WatchedTable], decisions: DataFrame, baseline: DataFrame) -> None:
    """For each breaking incident, a copy of the last PASSED load, which still has what the new load lost.

    One write per incident; bronze is only read.
    """
    last = baseline.where("base_rank = 1").select("table_fqn", "load_id", "base_load_id")
    hit = decisions.where(F.col("top_class") == "breaking").join(last, ["table_fqn", "load_id"])
    by_name = {t.table: t for t in tables}
    for r in hit.select("table_fqn", "incident_id", "base_load_id").collect():
        loads = control.spark.createDataFrame([(r["table_fqn"], r["base_load_id"])], "table_fqn string, load_id string")
        for i, rows in by_name[r["table_fqn"]].rows_of(loads):
            preserve_evidence(rows, r["table_fqn"], r["incident_id"], f"{control.root}/evidence", part=i)


def _restated(tables: list[WatchedTable], events: DataFrame, earlier: DataFrame) -> DataFrame | None:
    """Restatement evidence for the rescaled columns of `events`, from the rows of the loads in `earlier`: one join per (table, column), over the loads concerned."""
    suspects = write_through(events.where(RESCALED).select(*KEYS, "column_before"), "suspects")
    by_name = {t.table: t for t in tables}
    parts = []
    for table, column in suspects.select("table_fqn", "column_before").distinct().collect():  # names, bounded by the width of the tables
        t = by_name[table]
        if not t.key:
            continue
        cols = [t.key, column, "_load_id", "_loaded_at"]
        new, old = ([df.select(*cols) for _, df in t.rows_of(loads) if {c.upper() for c in cols} <= {c.upper() for c in df.columns}]
                    for loads in (suspects.where(F.col("column_before") == column).select(*KEYS), earlier))
        if new and old:
            parts.append(restatement(_union(new), _union(old), t.table, t.key, column))
    return _union(parts) if parts else None
