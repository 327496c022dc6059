"""Registered queries against their SQL. ALL_QUERIES=1 runs every one; otherwise one per area."""
import os

import pytest

import __spark_entry__ as entry
from loadwarden.catalog import ORACLES, QUERIES
from oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["revenue_daily", "dim_customers", "contract_misfits", "gate_latest", "profile_columns", "profile_topk", "theta_containment",
          "type_changes", "restatement_ratio", "downstream_closure", "route_decisions", "ledger", "model_tests",
          "secret_scan", "bronze_audit", "audit_locate", "stream_latest_per_key", "stream_windows", "stream_scan", "scan_decisions"]
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem, _, _ = compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_date", "channel", "segment", "orders", "revenue", "median_order"] and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())
