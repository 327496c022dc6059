"""Levels of the lineage, versions of models, approvals that are used up."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loadwarden.operators.gate import gate_latest
from loadwarden.operators.incidents import incident_latest
from loadwarden.plans.rebuild import Model, levels, published
from loadwarden.plans.release import approve, release, release_models, waiting
from loadwarden.sources.control import ControlPlane
from loadwarden.sources.registry import column_map


def test_levels_stand_above_what_they_read(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e"), ("x", "e"), ("e", "e")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    wanted = spark.createDataFrame([(m,) for m in "bcdex"], "model string")
    assert {r.model: r.level for r in levels(edges, wanted).collect()} == {"b": 0, "c": 0, "x": 0, "d": 1, "e": 2}
    assert levels(edges, wanted.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        levels(spark.createDataFrame([*pairs, ("e", "b")], "src string, dst string"), wanted)


def _plane(spark, root):
    control = ControlPlane(spark, root)
    start = datetime(2031, 5, 1)
    gate = [(1, "lab.raw.assays", "A1", "PASSED", None), (2, "lab.raw.assays", "A2", "QUARANTINED", "INC-7"), (3, "lab.raw.sites", "S1", "PASSED", None)]
    control.append("gate_log", spark.createDataFrame([(*g, "t", start, 10, False) for g in gate], control.read("gate_log").schema))
    fields = control.read("incident_log").columns
    row = {"seq": 0, "at": start, "incident_id": "INC-7", "table_fqn": "lab.raw.assays", "load_id": "A2", "status": "OPEN"}
    control.append("incident_log", spark.createDataFrame([tuple(row.get(f) for f in fields)], control.read("incident_log").schema))
    return control


def _models(spark, fails=False):
    def loads(table):
        return lambda log: gate_latest(log).where((F.col("table_fqn") == table) & (F.col("status") == "PASSED")).select("load_id")

    def test(df):
        return [df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit("stg_assays").alias("model"), F.lit("load_id").alias("column_name"), F.lit("made up").alias("test"),
                                                                   F.when(F.lit(fails), F.col("failures")).otherwise(0).cast("bigint").alias("failures"))]
    return {"stg_assays": Model((), loads("lab.raw.assays"), test), "stg_sites": Model((), loads("lab.raw.sites")),
            "both": Model(("stg_assays", "stg_sites"), lambda a, s: a.union(s)), "site_list": Model(("stg_sites",), lambda s: s.distinct())}


def test_only_the_affected_are_made_anew_and_swapped_together(spark, tmp_path):
    control = _plane(spark, str(tmp_path))
    edges = spark.createDataFrame([("model.l.stg_assays", "model.l.both"), ("model.l.stg_sites", "model.l.both"), ("model.l.stg_sites", "model.l.site_list")],
                                  "src string, dst string")
    columns = column_map(spark, "stg_assays", "lab.raw.assays", "id", [{"alias": "id", "source": "id", "type": "varchar"}]).unionByName(
        column_map(spark, "stg_sites", "lab.raw.sites", "id", [{"alias": "id", "source": "id", "type": "varchar"}]))

    def run(at, fails=False):
        return {r.model: (r.row_count, r.failures, r.published, r.level)
                for r in release_models(control, None, _models(spark, fails), columns, edges, datetime(2031, 5, at, 12)).collect()}

    def state():
        inc = incident_latest(control.read("incident_log")).first()
        return gate_latest(control.read("gate_log")).where("load_id = 'A2'").first().status, inc.status

    assert run(2) == {"stg_assays": (1, 0, True, 0), "stg_sites": (1, 0, True, 0), "both": (2, 0, True, 1), "site_list": (1, 0, True, 1)}
    first = {r.model: r.version for r in published(control).collect()}
    approve(control, "INC-7", "someone", datetime(2031, 5, 3))
    assert [r.load_id for r in waiting(control).collect()] == ["A2"]
    assert run(3, fails=True) == {"stg_assays": (2, 2, False, 0), "both": (3, 0, False, 1)}
    # the old versions serve on, the load is held, and the word is used up
    assert {r.model: r.version for r in published(control).collect()} == first and state() == ("QUARANTINED", "OPEN")
    assert waiting(control).count() == 0
    assert run(4) == {} and state() == ("QUARANTINED", "OPEN")
    approve(control, "INC-7", "someone", datetime(2031, 5, 5))
    assert run(5) == {"stg_assays": (2, 0, True, 0), "both": (3, 0, True, 1)}
    assert state() == ("PASSED", "RESOLVED")
    now = {r.model: r.version for r in published(control).collect()}
    assert {m for m in now if now[m] != first[m]} == {"stg_assays", "both"}
    assert waiting(control).count() == 0


def test_a_second_release_needs_a_new_word(spark, tmp_path):
    control = _plane(spark, str(tmp_path))
    failing = spark.createDataFrame([("m", "c", "unique", 1)], "model string, column_name string, test string, failures bigint")
    seen = []

    def build(log):
        seen.append(gate_latest(log).where("load_id = 'A2'").first().status)
        # nothing of the release is in the log yet while the models are made
        assert gate_latest(control.read("gate_log")).where("load_id = 'A2'").first().status == "QUARANTINED"
        return {}

    approve(control, "INC-7", "someone", datetime(2031, 5, 3))
    for day in (4, 5):
        release(control, None, build, lambda m: [failing if day == 4 else failing.where("failures = 0")], datetime(2031, 5, day))
    assert seen == ["PASSED", "QUARANTINED"]
    assert gate_latest(control.read("gate_log")).where("load_id = 'A2'").first().status == "QUARANTINED"
