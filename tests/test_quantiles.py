import math
import random

import pytest
from pyspark.sql import functions as F

from loadwarden.operators.quantiles import exact_quantiles

PROBS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def _brute(values, p):
    s = sorted(values)
    pos = (len(s) - 1) * p
    lo, hi = s[math.floor(pos)], s[math.ceil(pos)]
    return lo + (hi - lo) * (pos - math.floor(pos))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_matches_brute_force(spark, accuracy):
    rnd = random.Random(accuracy)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ten": [float(i) for i in range(10)], "ties": [7.0] * 500 + [8.0] * 3,
        "hot": [rnd.gauss(0, 1e6) for _ in range(20_000)], "coarse": [float(rnd.randrange(5)) for _ in range(3_000)],
        "tail": [1.0] * 2_000 + [10.0 ** i for i in range(40)], None: [float(i * i) for i in range(37)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(_brute(vs, p), rel=1e-12, abs=1e-12), (k, name)


def test_totals_count_every_row(spark):
    rows = [("a", float(i), i) for i in range(100)] + [("a", None, 5), ("b", None, 7)]
    df = spark.createDataFrame(rows, "k string, v double, x bigint")
    got = {r.k: (r.n, r.s, r.p50) for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5}, 20, {"n": F.lit(1), "s": F.col("x")}).collect()}
    assert got == {"a": (101, 4955, 49.5), "b": (1, 7, None)}


def test_no_group_is_gathered(spark):
    """The plan holds no aggregate that keeps a group's values; what is sorted per group are brackets."""
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v")
    plan = exact_quantiles(df, ["k"], "v", PROBS)._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "median(" not in plan and "collect_list" not in plan
