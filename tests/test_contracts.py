"""Contract intervals over a row of changes."""
import pytest

from loadwarden.operators.contracts import contract_as_of, contract_versions, rewritten_contract
from loadwarden.sources.registry import source_contract

EVENTS = "table_fqn string, load_id string, drift_class string, subtype string, column_before string, column_after string, type_after string"


@pytest.fixture(scope="module")
def changes(spark):
    contract = source_contract(spark, [("t", "Id", "number(9,0)", "the key", {"a": "b"}), ("t", "CODE", "varchar", None, None), ("u", "X", "date", None, None)])
    events = spark.createDataFrame([
        ("t", "L2", "additive", "column_added", None, "note", "VARCHAR"),
        ("t", "L3", "type_widening", "lossless_widening", "ID", "id", "NUMBER(18,0)"),
        ("t", "L4", "rename", "column_renamed", "NOTE", "REMARK", "VARCHAR"),
        ("t", "L5", "breaking", "column_dropped", "CODE", None, None),
        ("t", "L6", "additive", "column_added", None, "CODE", "BOOLEAN"),
        ("t", "L7", "additive", "column_added", None, "REMARK", "VARCHAR"),
        ("t", "L7", "semantic", "unit_change", "ID", "ID", "NUMBER(18,0)"),
        ("t", "L7", "breaking", "column_dropped", "NEVER", None, None)], EVENTS)
    return contract, events


def test_as_of(spark, changes):
    versions = contract_versions(*changes)
    loads = spark.createDataFrame([("t", f"L{i}") for i in range(1, 8)] + [("u", "A"), ("t", "L1"), ("v", "L1")], "table_fqn string, load_id string")
    got = {}
    for r in contract_as_of(loads, versions).collect():
        got.setdefault((r.table_fqn, r.load_id), {})[r.column_name] = (r.data_type, r.since)
    first, code = {"ID": ("number(9,0)", "")}, {"CODE": ("varchar", "")}
    wide, remark = {"ID": ("number(18,0)", "L3")}, {"REMARK": ("varchar", "L4")}
    assert got == {("u", "A"): {"X": ("date", "")}, ("t", "L1"): first | code, ("t", "L2"): first | code | {"NOTE": ("varchar", "L2")},
                   ("t", "L3"): wide | code | {"NOTE": ("varchar", "L2")}, ("t", "L4"): wide | code | remark, ("t", "L5"): wide | remark,
                   ("t", "L6"): wide | remark | {"CODE": ("boolean", "L6")}, ("t", "L7"): wide | remark | {"CODE": ("boolean", "L6")}}


def test_intervals_do_not_overlap(changes):
    rows = contract_versions(*changes).collect()
    for a in rows:
        assert a.valid_to is None or a.valid_from < a.valid_to
        for b in rows:
            if a is not b and (a.table_fqn, a.column_name) == (b.table_fqn, b.column_name):
                assert (a.valid_to or "~") <= b.valid_from or (b.valid_to or "~") <= a.valid_from


def test_rewritten(changes):
    contract, events = changes
    got = {(r.table_fqn, r.column_name): (r.data_type, r.description, r.meta) for r in rewritten_contract(contract, contract_versions(contract, events)).collect()}
    assert got == {("t", "Id"): ("number(18,0)", "the key", {"a": "b"}), ("t", "CODE"): ("boolean", None, None), ("t", "REMARK"): ("varchar", "Since load L4", None),
                   ("u", "X"): ("date", None, None)}
    assert contract_versions(contract.limit(0), events.limit(0)).count() == 0
