"""The steps that grow with the loads: typed profiles, stored variants, re-sent rows, the second run in another arrangement."""
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loadwarden.catalog import drift, fixes, given
from loadwarden.catalog.given import Given
from loadwarden.operators import profile
from loadwarden.operators.profile import (PROFILE_COLUMNS, changed_profiles, column_medians, exact_profile, exact_profiles, load_counts, long_values, top_lists,
                                          value_counts)
from loadwarden.operators.quantiles import quantiles_within
from loadwarden.operators.remediate import recode_pairs
from loadwarden.operators.rename import exact_containment, last_profiles
from loadwarden.operators.semantic import restatement

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(f"L{i % 3}", i if i % 7 else None, Decimal(i % 50) / 4 if i % 5 else None, (i % 11) / 3.0 if i % 4 else -0.0, f"c{i % 30}" if i % 3 else None,
             i % 2 == 0, datetime(2030, 1, 1 + i % 9), [i % 4], None) for i in range(400)]
    schema = "_load_id string, a bigint, b decimal(9,2), c double, d string, e boolean, f timestamp_ntz, g array<int>, h double"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([("M1", "x", 1), ("M1", None, 1), ("M2", None, None)], "_load_id string, d string, `odd.name` int")


def _plain(df):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else {k: round(x, 9) for k, x in sorted(v.items())} if isinstance(v, dict) else v

    return sorted((tuple(cell(v) for v in r) for r in df.select(*PROFILE_COLUMNS).collect()), key=repr)


def test_typed_profiles_are_those_of_value_counts(spark, mixed):
    many, few = mixed
    want = exact_profile(long_values(many, "t").unionByName(long_values(few, "t")))
    assert _plain(exact_profiles([(many, "t"), (few, "t")])) == _plain(want)


def test_typed_profiles_without_numbers_or_codes(spark):
    for rows, schema in (([("L", "x")], "_load_id string, d string"), ([("L", 1)], "_load_id string, a int"), ([("L", datetime(2030, 1, 1))], "_load_id string, f date")):
        df = spark.createDataFrame(rows, schema)
        assert _plain(exact_profiles([(df, "t")])) == _plain(exact_profile(long_values(df, "t")))


def test_counts_of_one_schema_are_those_of_long_values(spark, mixed):
    want, got = value_counts(long_values(mixed[0], "t")), load_counts(mixed[0], "t")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_variants_are_made_from_a_stored_load(spark):
    g = Given(spark, SF)
    assert not any(SF in f for df in g.variants.values() for f in df.inputFiles())
    assert g.variants["L2001.clean"].count() == g.orders.where("_load_id = 'L2001'").count()


def test_profiles_hold_no_text_of_numbers(spark, monkeypatch):
    """Only text and boolean columns may be turned into value text: keys and amounts are as many as the rows."""
    seen = set()
    monkeypatch.setattr(profile, "canonical_text", lambda c, dt: seen.add(dt.typeName()) or c.cast("string"))
    Given(spark, SF).profiles.count()
    assert seen <= {"string", "boolean"}


def test_containment_counts_only_changed_columns_of_their_loads(spark):
    got = {(r.load_id[:6] if "." in r.load_id else "old", r.column_name) for r in Given(spark, SF).changed_counts.select("load_id", "column_name").distinct().collect()}
    assert got == {("old", c) for c in ("CUST_ID", "STATUS", "CHANNEL")} | {("L2001.", c) for c in ("ORDER_MONTH", "SETTLED", "CUSTOMER_KEY", "ACCOUNT_NO", "CHANNEL_CODE")}


def test_resent_rows_are_joined_once(spark):
    at = "timestamp'2030-01-01 00:00:00'"
    rows = spark.range(100).selectExpr("id AS k", "double(id + 1) AS v", "'L1' AS _load_id", f"{at} AS _loaded_at")
    got = restatement(rows.withColumns({"_load_id": F.lit("L2"), "v": F.col("v") / 4}), rows, "t", "k", "v")
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.matched_rows, r.ratio_median, round(r.ratio_cv, 9)) for r in got.collect()] == [(100, 4.0, 0.0)]


def test_second_run_is_arranged_once(spark, monkeypatch):
    worlds = []
    monkeypatch.setattr(drift, "Given", lambda *a: worlds.append(Given(*a)) or worlds[-1])
    assert {r.differences for r in drift.determinism_check(Given(spark, SF)).collect()} == {0}
    assert not any(SF in f for f in worlds[0].orders.inputFiles())


def test_resent_rows_are_looked_for_in_rescaled_loads_alone(spark, monkeypatch):
    loads = []
    monkeypatch.setattr(given, "restatement", lambda new, *a: loads.extend(r[0] for r in new.select("_load_id").distinct().collect()) or restatement(new, *a))
    found = Given(spark, SF).events.where("drift_class = 'semantic'").select("column_before", F.col("evidence.restatement_check.matched_rows").alias("n")).collect()
    assert [r.n > 0 for r in found if r.column_before == "AMOUNT"] == [True]
    assert loads == ["L2001.semantic"]


def test_medians_are_of_columns_that_a_check_reads(spark, monkeypatch):
    made = []
    monkeypatch.setattr(profile, "quantiles_within", lambda rows, *a: made.append({tuple(r) for r in rows.select("load_id", "column_name").distinct().collect()}) or quantiles_within(rows, *a))
    g = Given(spark, SF)
    assert {r.column_name for r in g.medians.collect()} == {"AMOUNT", "CUST_ID"}
    assert {c for k, c in made[0] if k == "L2001.widening"} == {"CUST_ID"} and {c for k, c in made[0] if k == "L2001.rename"} == {"AMOUNT"}


def test_split_profiles_are_those_of_value_counts(spark, mixed):
    many, few = mixed
    want = {(r.load_id, r.column_name): r for r in exact_profile(long_values(many, "t").unionByName(long_values(few, "t"))).collect()}
    pairs = [(many, "t"), (few, "t")]
    medians = column_medians([(many, "t", frozenset({"A", "B", "C", "H"})), (few, "t", frozenset({"ODD.NAME"}))]).collect()
    assert {(r.load_id, r.column_name): r.num_median for r in medians} == {k: r.num_median for k, r in want.items() if r.num_median is not None}
    assert {(r.load_id, r.column_name): r.top_k for r in top_lists(pairs).collect()} == {k: r.top_k for k, r in want.items() if r.top_k is not None}
    changed = changed_profiles(load_counts(many, "t").unionByName(load_counts(few, "t"))).collect()
    assert {(r.load_id, r.column_name): (r.null_rate, r.distinct_count) for r in changed} == {k: (r.null_rate, r.distinct_count) for k, r in want.items()}


def test_old_values_are_counted_for_all_baseline_loads_together(spark):
    """A key that comes in every baseline load is one old value, not one for each load and candidate."""
    g = Given(spark, SF)
    keys = g.changed_counts.where("column_name = 'CUST_ID' and load_id like 'all of %'")
    assert keys.count() == g.baseline.select("cust_id").distinct().count()


def test_containment_is_of_each_candidates_own_baseline(spark):
    diff = spark.createDataFrame([("t", k, c, a, b, "numeric") for k in ("N1", "N2") for c, a, b in (("dropped", "old", None), ("added", None, "new"))],
                                 "table_fqn string, load_id string, change string, column_before string, column_after string, family string")
    base = spark.createDataFrame([("t", "N1", "B1"), ("t", "N1", "B2"), ("t", "N2", "B2")], "table_fqn string, load_id string, base_load_id string")
    counts = spark.createDataFrame([("t", k, c, v) for k, c, vs in (("B1", "OLD", "123"), ("B2", "OLD", "34"), ("N1", "NEW", "1239"), ("N2", "NEW", "1239")) for v in vs],
                                   "table_fqn string, load_id string, column_name string, value string")
    assert {r.load_id: r.containment for r in exact_containment(diff, base, counts).collect()} == {"N1": 0.75, "N2": 0.25}


def _without(monkeypatch, *steps):
    for s in steps:
        monkeypatch.setattr(Given, s, property(lambda self, s=s: pytest.fail(f"{s} is not needed")), raising=False)


def test_contract_as_of_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "medians", "top_lists")
    assert fixes.contract_as_of(Given(spark, SF)).count() > 0


def test_normalise_unit_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "changed_counts", "top_lists")
    assert fixes.normalise_unit(Given(spark, SF)).count() > 0


def test_recode_apply_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "medians")
    assert fixes.recode_apply(Given(spark, SF)).count() > 0


def test_contract_gaps_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "structural_events", "scored", "medians")
    assert fixes.contract_gaps(Given(spark, SF)).count() > 0


def test_recode_pairs_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "medians")
    assert fixes.recode_pairs(Given(spark, SF)).count() > 0


def test_recode_pairs_reads_codes_alone(spark, monkeypatch):
    """Keys are as many as the rows, and no recoding rests on them: neither their values nor their containment are needed."""
    _without(monkeypatch, "changed_counts", "structural_events", "top_lists", "medians")
    g = Given(spark, SF)
    assert fixes.recode_pairs(g).count() > 0
    assert {r[0] for r in g.code_counts.select("column_name").distinct().collect()} == {"STATUS", "CHANNEL", "ORDER_MONTH", "SETTLED", "CHANNEL_CODE"}


def test_recodings_beside_a_renamed_text_are_those_of_all_events(spark):
    g = Given(spark, SF)
    g.orders = g.orders.withColumn("note", F.concat(F.lit("n"), (F.col("order_id") % 60).cast("string")))
    lost = g.variants["L2001.breaking"].withColumnRenamed("note", "remark").drop("cust_id")
    g.variants = {**g.variants, "L2001.lost": lost.withColumn("_load_id", F.lit("L2001.lost"))}
    want = recode_pairs(g.structural_events, last_profiles(g.top_lists, g.structure[0]), g.top_lists).collect()
    assert sorted(fixes._pairs(g).collect()) == sorted(want)
    assert {(r.column_before, r.column_after) for r in want if r.load_id == "L2001.lost"} == {("STATUS", "SETTLED")}
    events = lambda df: {r.event_id for r in df.where("coalesce(column_before, column_after) IN ('NOTE', 'STATUS', 'SETTLED')").collect()}
    assert events(g.code_events) == events(g.structural_events.where("drift_class <> 'semantic'")) != set()


def test_rename_rejections_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "detection", "events", "medians", "top_lists")
    assert drift.rename_rejections(Given(spark, SF)).count() > 0


def test_blast_radius_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "events", "restated")
    assert drift.blast_radius(Given(spark, SF)).count() > 0


def test_route_decisions_runs_the_steps_it_reads(spark, monkeypatch):
    _without(monkeypatch, "events", "restated")
    assert drift.route_decisions(Given(spark, SF)).count() > 0
