"""Rules of single operators on small fixtures."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loadwarden.functions import ids, stats
from loadwarden.operators import lineage, quality, rename, semantic, sketches, staging
from loadwarden.policy import SEVERITY, THRESHOLDS, Policy

T, L = "t", "N"
COLUMNS = [("A", "numeric", "NUMBER(10,2)"), ("S", "text", "VARCHAR")]


def _checks(spark, base, new, families=("A",)):
    """base: list of medians (or share maps) per load."""
    numeric = isinstance(new, (int, float)) or new is None
    col, fam, dt = COLUMNS[0] if numeric else COLUMNS[1]
    diff = spark.createDataFrame([(T, L, "unchanged", col, dt, fam)], "table_fqn string, load_id string, change string, "
                                                                      "column_before string, type_after string, family string")
    loads = spark.createDataFrame([(T, L, f"B{i}", i + 1) for i in range(len(base))],
                                  "table_fqn string, load_id string, base_load_id string, base_rank int")
    rows = [(T, f"B{i}", col, v if numeric else None, None if numeric else v) for i, v in enumerate(base)]
    rows.append((T, L, col, new if numeric else None, None if numeric else new))
    prof = spark.createDataFrame(rows, "table_fqn string, load_id string, column_name string, num_median double, top_k map<string,double>")
    if numeric:
        return semantic.numeric_checks(diff, prof, loads, THRESHOLDS).first()
    return semantic.categorical_checks(semantic.category_shares(diff, prof, loads, THRESHOLDS), THRESHOLDS).first()


def test_busy_day_is_no_alarm(spark):
    r = _checks(spark, [2400.0, 2410.0, 2420.0, 2430.0], 2600.0)
    assert not r.flagged and r.hypothesis is None


@pytest.mark.parametrize("new,direction,label", [(28.57, "down", "INR"), (201600.0, "up", "INR"), (24.0, "down", "major unit"), (240.0, None, None)])
def test_unit_hypotheses(spark, new, direction, label):
    r = _checks(spark, [2394.0, 2400.0, 2406.0, 2394.0, 2400.0], new)
    assert r.flagged
    assert (r.hypothesis.direction if r.hypothesis else None) == direction
    assert label is None or r.hypothesis.label.startswith(label)


@pytest.mark.parametrize("base,new", [([1.0, 2.0], 100.0), ([0.0, 0.0, 5.0, 6.0], 100.0), ([1.0, 2.0, 3.0], 0.0), ([1.0, 2.0, 3.0], None)])
def test_too_little_history(spark, base, new):
    assert _checks(spark, base, new) is None


def test_constant_baseline_uses_the_floor(spark):
    r = _checks(spark, [100.0] * 5, 400.0)
    assert r.robust_z == round(300 / (1.4826 * 1.0), 1)


def test_code_swap_and_new_domain(spark):
    base = [{"C": 0.8, "A": 0.2}] * 4
    swap = _checks(spark, base, {"C": 0.2, "A": 0.8})
    assert swap.flagged and swap.subtype == "code_meaning_change" and swap.domain_overlap == 1.0
    assert swap.psi == round(2 * 0.6 * math.log(4), 3)
    other = _checks(spark, base, {"X": 0.5, "Y": 0.5})
    assert other.flagged and other.subtype == "new_value_domain" and other.domain_overlap == 0.0
    same = _checks(spark, base, {"C": 0.79, "A": 0.21})
    assert not same.flagged


def test_absent_baseline_value_counts_zero(spark):
    r = _checks(spark, [{"a": 1.0}, {"a": 0.5, "b": 0.5}, {"a": 1.0}], {"a": 1.0})
    e = {"a": 2.5 / 3, "b": 0.5 / 3}
    a = {"a": 1.0, "b": 1e-4}
    assert r.psi == round(sum((a[k] - e[k]) * math.log(a[k] / e[k]) for k in e), 3)


def test_greedy_matching_equals_brute_force(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for load in range(15):
        cand = [(round(0.9 + rnd.randrange(10) / 100, 2), f"d{d}", f"a{a}") for d, a in itertools.product(range(5), range(4)) if rnd.random() < 0.6]
        rows += [(T, f"l{load}", d, a, "X", "X", "same", s, s, 1.0, 1.0, None) for s, d, a in cand]
        used, picked = set(), set()
        for s, d, a in sorted(cand, key=lambda c: (-c[0], c[1], c[2])):
            if ("d", d) not in used and ("a", a) not in used:
                used |= {("d", d), ("a", a)}
                picked.add((d, a))
        want[f"l{load}"] = picked
    df = spark.createDataFrame(rows, "table_fqn string, load_id string, column_before string, column_after string, type_before string, "
                                     "type_after string, type_relation string, score double, value_containment double, "
                                     "null_similarity double, distinct_ratio double, reason string")
    got = {}
    for r in rename.rename_pairs(df).collect():
        got.setdefault(r.load_id, set()).add((r.column_before, r.column_after))
    assert got == {k: v for k, v in want.items() if v}


def test_matching_of_wide_loads(spark):
    rnd = random.Random(4)
    rows, want = [], set()
    # one load with about 10,000 pairs of all scores, one whose equal scores make every pair wait for the one before
    wide = [("wide", rnd.random(), f"d{d:03}", f"a{a:03}") for d in range(200) for a in range(200) if rnd.random() < 0.25]
    chain = [("chain", 0.95, f"d{d:03}", f"a{a:03}") for d in range(12) for a in range(12)]
    for load, s, d, a in sorted(wide + chain, key=lambda c: (-c[1], c[2], c[3])):
        rows.append((T, load, d, a, "X", "X", "same", s, s, 1.0, 1.0, None if s >= 0 else "low"))
        if not {(load, d), (load, a)} & {x for p in want for x in ((p[0], p[1]), (p[0], p[2]))}:
            want.add((load, d, a))
    df = spark.createDataFrame(rows, "table_fqn string, load_id string, column_before string, column_after string, type_before string, "
                                     "type_after string, type_relation string, score double, value_containment double, "
                                     "null_similarity double, distinct_ratio double, reason string")
    got = rename.rename_pairs(df).collect()
    assert {(r.load_id, r.column_before, r.column_after) for r in got} == want and len(got) == len(want)
    assert rename.rename_pairs(df.limit(0)).count() == 0


def test_closure_survives_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("x", "y")], "src string, dst string")
    got = lineage.downstream(edges, spark.createDataFrame([("a",), ("x",), ("none",)], "node string")).collect()
    assert {(r.start, r.node) for r in got} == {("a", n) for n in "bcde"} | {("x", "y")} and len(got) == 5
    hit = lineage.affected_models(spark.createDataFrame([("model.p.s", "model.p.m"), ("model.p.m", "exposure.p.x")], "src string, dst string"),
                                  spark.createDataFrame([("model.p.s",)], "node string"))
    assert {r.model for r in hit.collect()} == {"s", "m"}


def test_expression_readers(spark):
    consumed = spark.createDataFrame([("lake.orders", "n", "ID")], "table_fqn string, load_id string, column string")
    maps = spark.createDataFrame([("m1", "x.ORDERS", None, "case when cust_id > 1 then 1 end"), ("m2", "x.ORDERS", "id", None), ("m3", "x.other", "id", None)],
                                 "model string, table_fqn string, source string, expr string")
    assert {r.model for r in lineage.staging_readers(consumed, maps).collect()} == {"m1", "m2"}
    assert {r.model for r in lineage.staging_readers(consumed, maps, whole_words=True).collect()} == {"m2"}


@pytest.mark.parametrize("models,exposures,tier1,tier", [(4, 0, False, "high"), (1, 1, True, "high"), (2, 0, False, "medium"), (1, 1, False, "medium"), (1, 0, False, "low")])
def test_tiers(spark, models, exposures, tier1, tier):
    df = spark.createDataFrame([(models, exposures, tier1)], "m int, x int, t boolean")
    assert df.select(lineage.blast_tier(F.col("m"), F.col("x"), F.col("t"), Policy().blast)).first()[0] == tier


@pytest.mark.parametrize("spent,budget,mode", [(0, 0, "normal"), (79, 100, "normal"), (80, 100, "critical_only"), (100, 100, "paused"), (250, 100, "paused")])
def test_budget(spark, spent, budget, mode):
    assert spark.createDataFrame([(spent, budget)], "a int, b int").select(stats.budget_mode(F.col("a"), F.col("b"))).first()[0] == mode


def test_secrets(spark):
    texts = ["nothing here", "x -----BEGIN " + "RSA PRIVATE KEY----- y", "token ghp_" + "a1B2" * 8, "ghp_short", "pad " * 5000 + "ATATT" + "x" * 24]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hits = {(r.id, r.pattern) for r in quality.secret_hits(df, "text").collect()}
    assert hits == {(1, "private_key"), (2, "vcs_token"), (4, "tracker_token")}


def test_policy_tables(spark):
    assert quality.policy_findings(spark, Policy()).count() == 0
    worse = {**SEVERITY, "rename": {"low": "SEV1", "medium": "SEV2", "high": "SEV3"}, "new_class": {"low": "SEV4", "medium": "SEV4", "high": "SEV4"}}
    found = {(r[0], r[1]) for r in quality.policy_findings(spark, Policy(severity=worse)).collect()}
    assert found == {("severity_improves", "rename"), ("no_precedence", "new_class")}
    assert quality.free_text_inputs(spark.sql("select 1 as load_id, 'x' as narrative")) == ["narrative"]


def test_checksum_ignores_order_but_not_values(spark):
    a = spark.range(100).selectExpr("id", "id * 2 as v", "'l' as _load_id")
    base = quality.load_checksums(a)
    assert not quality.changed_loads(base, quality.load_checksums(a.orderBy(F.desc("id")).repartition(3))).first().changed
    assert quality.changed_loads(base, quality.load_checksums(a.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v"))))).first().changed


def test_contract(spark):
    cols = [{"alias": "amount", "source": "amt", "type": "number(4,2)"}, {"alias": "name", "source": "nm", "type": "varchar"}]
    df = spark.sql("select cast(1.5 as double) amt, 'x' nm, 'l' _load_id, now() _loaded_at union all select 1000.0, 'y', 'l', now()")
    model = staging.mapped(df, cols)
    assert staging.contract_differences(model, cols) == []
    assert staging.contract_differences(model.drop("name").withColumn("extra", F.lit(1)), cols) == [
        ("name", "string", "absent"), ("extra", "absent", "int")]
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented"):
        model.collect()
    assert {r.column_name: r.misfits for r in staging.misfits(df, cols).collect()} == {"amount": 1, "name": 0}


def test_tags_and_branches(spark):
    df = spark.createDataFrame([("sentry", "INC-1"), ("sentry", None)], "a string, i string")
    assert [r[0] for r in df.select(ids.query_tag("app", F.col("a"), F.col("i"))).collect()] == [
        '{"app":"app","agent":"sentry","incident":"INC-1"}', '{"app":"app","agent":"sentry"}']
    refs = ["refs/heads/fix/inc-0123abcd-rename", "fix/INC-0123ABCD-x", "fix/inc-0123abcd", "main", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in refs], "r string").select(ids.incident_from_branch(F.col("r"))).collect()]
    assert got == ["INC-0123ABCD", "INC-0123ABCD", None, None, None]


def test_merge_rules(spark):
    rows = [("SEV1", False, "success", 3), ("SEV1", True, "success", 3), ("SEV3", None, "pending", 3), ("SEV4", None, "success", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, severity string, approved boolean, ci_state string, decisions int")
    got = {r.id: r.violations for r in quality.merge_audit(df, Policy()).collect()}
    assert got == {0: ["human_approval"], 1: [], 2: ["tests_before_merge"], 3: ["decisions_traced"]}


def test_minhash_containment_of_a_renamed_column(spark):
    """Equal value sets: every signature position agrees, so the containment is 1 whatever the sketch error."""
    long = spark.range(500).selectExpr("'t' as table_fqn", "'b' as load_id", "'OLD' as column_name", "cast(id as string) as value").unionByName(
        spark.range(500).selectExpr("'t' as table_fqn", "'n' as load_id", "'NEW' as column_name", "cast(id as string) as value"))
    states = sketches.minhash_states(long)
    pair = states.selectExpr("table_fqn", "'n' as load_id", "'OLD' as column_before", "'NEW' as column_after", "column_name", "minhash")
    base = pair.where("column_name = 'OLD'").drop("column_name").withColumn("n_base", F.lit(500.0))
    new = pair.where("column_name = 'NEW'").drop("column_name").withColumn("n_new", F.lit(500.0))
    assert sketches.minhash_containment(base, new).first().containment == 1.0
