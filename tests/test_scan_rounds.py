"""Loads that arrive together are decided as if they had come one by one; evidence copies outlive a killed write."""
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadwarden.operators.gate import gate_latest, rolling_baseline
from loadwarden.plans.scan import Lineage, WatchedTable, bootstrap, scan
from loadwarden.policy import Policy
from loadwarden.sources import bronze
from loadwarden.sources.control import ControlPlane, preserve_evidence
from loadwarden.sources.lineage import lineage_tables
from loadwarden.sources.registry import column_map

HEAT, GATES = "plant.raw.heat", "plant.raw.gates"
EDGES = [("source.plant.raw.heat", "model.plant.stg_heat"), ("model.plant.stg_heat", "model.plant.boiler_hours")]
NODES = [(f"model.plant.{m}", "model", m, None, None, None, None, None) for m in ("stg_heat", "boiler_hours")]
MAP = [{"alias": "probe", "source": "probe", "type": "varchar"}, {"alias": "joule", "source": "joule", "type": "float"}]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plant"))
    heat = bronze.generated_loads(spark, {"reading": F.col("id"), "probe": F.concat(F.lit("p"), (F.col("id") * 7 % 5).cast("string")),
                                          "joule": 40 + 4 * F.randn(2), "valve": bronze.pick(["open", "shut"], 3, [4, 1])}, loads=8, rows_per_load=300, prefix="H")
    gates = bronze.generated_loads(spark, {"passage": F.col("id"), "gate": bronze.pick(["n", "e", "s"], 4), "weight": 900 + 20 * F.randn(5)},
                                   loads=6, rows_per_load=200, prefix="H")
    heat.write.parquet(f"{root}/heat")
    gates.write.parquet(f"{root}/gates")
    heat, gates = spark.read.parquet(f"{root}/heat"), spark.read.parquet(f"{root}/gates")
    ids = sorted(r[0] for r in heat.select("_load_id").distinct().collect())
    odd = F.col("_load_id") == ids[5]
    heat = heat.withColumn("joule", F.when(odd, F.col("joule") * 1000).otherwise(F.col("joule")))
    # the last load of the second table brings a column, which is no reason to hold it
    old = gates.where(F.col("_load_id") < ids[5])
    new = gates.where(F.col("_load_id") == ids[5]).withColumn("lane", F.lit(1))
    return ids, [WatchedTable(HEAT, "reading", [heat]), WatchedTable(GATES, "passage", [old, new])]


def up_to(tables, load):
    return [WatchedTable(t.table, t.key, [p.where(F.col("_load_id") <= load) for p in t.parts]) for t in tables]


def outcome(control):
    """What a scan leaves behind, without the medians: those come from sketches that draw at random."""
    return (sorted((r.table_fqn, r.load_id, r.status, r.incident_id) for r in gate_latest(control.read("gate_log")).collect()),
            sorted(tuple(r) for r in control.read("comparisons").collect()),
            sorted((r.event_id, r.load_id, r.subtype, r.confidence, json.loads(r.evidence).get("baseline_loads")) for r in control.read("drift_events").collect()),
            sorted((r.incident_id, r.status, r.severity) for r in control.read("incident_log").collect()))


def test_at_once_as_one_by_one(spark, tables, tmp_path):
    ids, watched = tables
    lineage = Lineage(column_map(spark, "stg_heat", HEAT, "reading", MAP), *lineage_tables(spark, EDGES, NODES), "plant")
    at = datetime(2031, 4, 1, 8)
    once, single = (ControlPlane(spark, str(tmp_path / n)) for n in ("once", "single"))
    for control in (once, single):
        assert bootstrap(control, up_to(watched, ids[3]), at) == 8
    decisions = scan(once, watched, lineage, Policy(), at + timedelta(hours=1))
    for k, load in enumerate(ids[4:]):
        scan(single, up_to(watched, load), lineage, Policy(), at + timedelta(hours=2 + k))
    for a, b in zip(outcome(once), outcome(single)):
        assert a == b
    got = {(r.table_fqn, r.load_id): r.top_class for r in decisions.collect()}
    assert len(got) == 6 and {k for k, v in got.items() if v == "semantic"} == {(HEAT, ids[5])} and got[GATES, ids[5]] == "additive"
    # the load behind a held one is compared with those that passed
    compared = {r.base_load_id for r in once.read("comparisons").where(F.col("load_id") == ids[7]).collect()}
    assert compared == {*ids[:5], ids[6]}
    assert scan(once, watched, lineage, Policy(), at + timedelta(hours=20)).count() == 0


def test_only_the_named_loads_are_taken(spark, tables, tmp_path):
    ids, watched = tables
    lineage = Lineage(column_map(spark, "stg_heat", HEAT, "reading", MAP), *lineage_tables(spark, EDGES, NODES), "plant")
    control = ControlPlane(spark, str(tmp_path))
    bootstrap(control, up_to(watched, ids[3]), datetime(2031, 4, 1, 8))
    named = spark.createDataFrame([(HEAT, ids[4])], "table_fqn string, load_id string")
    assert [r.load_id for r in scan(control, watched, lineage, Policy(), datetime(2031, 4, 1, 9), only=named).collect()] == [ids[4]]


def test_rolling_baseline_takes_the_last_of_both(spark):
    gate = spark.createDataFrame([("t", f"a{k}", "PASSED") for k in range(9)] + [("t", "c1", "PENDING"), ("t", "c2", "PENDING"), ("u", "c1", "PENDING")],
                                 "table_fqn string, load_id string, status string")
    ranked = spark.createDataFrame([("t", "c1", 1), ("t", "c2", 2), ("u", "c1", 1)], "table_fqn string, load_id string, rank int")
    got = {}
    for r in rolling_baseline(gate, ranked, 3).collect():
        got.setdefault((r.table_fqn, r.load_id), {})[r.base_rank] = r.base_load_id
    assert got == {("t", "c1"): {1: "a8", 2: "a7", 3: "a6"}, ("t", "c2"): {1: "c1", 2: "a8", 3: "a7"}}


def test_a_killed_copy_is_made_again(spark, tmp_path):
    rows = spark.range(50)
    path = preserve_evidence(rows, "a.b.LOADS", "INC-1", str(tmp_path))
    (tmp_path / "LOADS_PRE_INC_1" / "part=0" / "_SUCCESS").unlink()
    for f in (tmp_path / "LOADS_PRE_INC_1" / "part=0").glob("*.parquet"):
        f.unlink()
    (tmp_path / "LOADS_PRE_INC_1" / "part=0" / "_temporary").mkdir()
    assert preserve_evidence(rows, "a.b.LOADS", "INC-1", str(tmp_path)) == path and spark.read.parquet(path).count() == 50
    # a whole copy is kept
    preserve_evidence(spark.range(9), "a.b.LOADS", "INC-1", str(tmp_path))
    assert spark.read.parquet(path).count() == 50
