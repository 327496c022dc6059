"""Checksum trees against a plain comparison of the rows."""
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadwarden.operators.audit_tree import audit_tree, changed_rows, differing_branches

SCHEMA = "_load_id string, k long, a string, b double"
CELLS = st.tuples(st.sampled_from(["L1", "L2", None]), st.sampled_from([None, 1, 2, 3, 4, 5]), st.sampled_from([None, "", "x", "y"]), st.sampled_from([None, 0.0, 1.5]))


def located(before, after, bits=1, depth=3):
    trees = [audit_tree(df, "k", bits=bits, depth=depth) for df in (before, after)]
    return changed_rows(before, after, differing_branches(*trees, bits=bits, depth=depth), "k", bits=bits, depth=depth)


def by_hand(before, after):
    out = set()
    for key in {r[:2] for r in before + after if r[0] is not None}:
        b, a = ([r for r in rows if r[:2] == key] for rows in (before, after))
        moved = tuple(n for i, n in ((2, "a"), (3, "b")) if Counter(r[i] for r in b) != Counter(r[i] for r in a))
        kind = "missing" if not a else "new" if not b else "repeated" if len(a) != len(b) else "value" if moved else None
        if kind:
            out.add((*key, kind, moved if kind == "value" else ()))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(CELLS, max_size=8), st.lists(CELLS, max_size=4), st.sets(st.integers(0, 7)))
def test_equals_a_comparison_of_all_rows(spark, rows, more, gone):
    after = [r for i, r in enumerate(rows) if i not in gone] + more
    got = located(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA)).collect()
    assert len(got) == len({(r.load_id, r.k) for r in got})
    assert {(r.load_id, r.k, r.change, tuple(r.columns)) for r in got} == by_hand(rows, after)


def test_one_value_is_found_down_one_branch(spark):
    before = spark.range(20_000).select(F.concat(F.lit("L"), F.col("id") % 4).alias("_load_id"), F.col("id").alias("k"), F.lit("x").alias("a"), F.lit(None).cast("double").alias("b"))
    after = before.withColumn("a", F.when(F.col("k") == 4321, "y").otherwise(F.col("a")))
    branches = differing_branches(audit_tree(before, "k"), audit_tree(after, "k"))
    path = sorted((r.level, r.load_id, r.rows_before) for r in branches.collect())
    assert [p[0] for p in path] == [0, 1, 2, 3] and {p[1] for p in path} == {"L1"}
    assert path[0][2] == 5000 and path[-1][2] < 20
    assert [(r.load_id, r.k, r.change, r.columns) for r in located(before, after, 4, 3).collect()] == [("L1", 4321, "value", ["a"])]
    assert differing_branches(audit_tree(before, "k"), audit_tree(before, "k")).count() == 0
    assert located(before, after.limit(0)).where("change = 'missing'").count() == 20_000


def test_nodes_sum_up(spark):
    rows = spark.createDataFrame([("L", i % 37, "x", 1.0) for i in range(200)], SCHEMA)
    tree = audit_tree(rows, "k").collect()
    for level in range(4):
        assert sum(r.row_count for r in tree if r.level == level) == 200
    assert len({sum(r.checksum for r in tree if r.level == level) for level in range(4)}) == 1
