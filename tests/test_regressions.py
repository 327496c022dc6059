"""One test per fault that was found after its query was green."""
import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from loadwarden.functions.ids import event_id
from loadwarden.operators.gate import gate_audit, request_order
from loadwarden.operators.lineage import downstream, staging_readers
from loadwarden.operators.quality import changed_loads, load_checksums
from loadwarden.operators.semantic import numeric_checks
from loadwarden.policy import THRESHOLDS
from loadwarden.sources.registry import watch_registry, with_owner


def test_moved_value_changes_the_checksum(spark):
    before = spark.createDataFrame([("L", "x", None)], "_load_id string, a string, b string")
    after = spark.createDataFrame([("L", None, "x")], "_load_id string, a string, b string")
    assert changed_loads(load_checksums(before), load_checksums(after)).first().changed
    assert not changed_loads(load_checksums(before), load_checksums(before)).first().changed


def test_baseline_around_zero_has_no_scale(spark):
    medians = [-5.0, -1.0, 1.0, 5.0]
    rows = [("t", f"b{i}", "C", m) for i, m in enumerate(medians)] + [("t", "new", "C", 900.0)]
    profiles = spark.createDataFrame(rows, "table_fqn string, load_id string, column_name string, num_median double")
    diff = spark.createDataFrame([("t", "new", "unchanged", "C", "C", "NUMBER(9,2)", "NUMBER(9,2)", "numeric")],
                                 "table_fqn string, load_id string, change string, column_before string, column_after string, type_before string, "
                                 "type_after string, family string")
    base = spark.createDataFrame([("t", "new", f"b{i}", i + 1) for i in range(4)], "table_fqn string, load_id string, base_load_id string, base_rank int")
    got = numeric_checks(diff, profiles, base, THRESHOLDS).collect()
    assert all(not r.flagged and r.factor is None for r in got)


def test_owner_of_tables_with_one_short_name(spark):
    reg = watch_registry(spark, [("a.x.ORDERS", True, "id", "team a"), ("b.x.ORDERS", True, "id", "team b"), ("a.x.LOGS", True, "id", "logs")])
    rows = spark.createDataFrame([("b.x.orders",), ("c.x.orders",), ("z.logs",)], "table_fqn string")
    assert {(r.table_fqn, r.owner) for r in with_owner(rows, reg).collect()} == {("b.x.orders", "team b"), ("c.x.orders", None), ("z.logs", "logs")}


def test_readers_of_tables_with_one_short_name(spark):
    maps = spark.createDataFrame([("m_a", "a.x.ORDERS", "C", None), ("m_b", "b.x.ORDERS", "C", None)], "model string, table_fqn string, source string, expr string")
    hit = spark.createDataFrame([("a.x.orders", "L", "C")], "table_fqn string, load_id string, column string")
    assert [r.model for r in staging_readers(hit, maps).collect()] == ["m_a"]


def test_ids_of_names_outside_ascii(spark):
    fields = ["lake.t", "L1", "additive", "column_added", None, "PREIS_Ä 😀"]
    df = spark.createDataFrame([tuple(fields)], "a string, b string, c string, d string, e string, f string")
    want = "DE-" + hashlib.sha256(json.dumps(fields, separators=(",", ":")).encode()).hexdigest()[:12]
    assert df.select(event_id(*(F.col(x) for x in "abcdef")).alias("i")).first().i == want


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)] + [("n14", "n0")], "src string, dst string")
    assert downstream(edges, spark.createDataFrame([("n0",)], "node string")).count() == 15


def test_many_requests_of_one_instant(spark):
    at = datetime(2050, 1, 1)
    rows = [(request_order(at, step), "t", f"l{i}", s, None, "x", at, None, False) for i in range(3000) for step, s in enumerate(("PENDING", "PASSED"))]
    from loadwarden.operators.gate import GATE_LOG_SCHEMA
    audited = gate_audit(spark.createDataFrame(rows, GATE_LOG_SCHEMA))
    assert audited.where("legal").count() == 6000 and audited.where("status = 'PASSED' and current = 'PENDING'").count() == 3000
