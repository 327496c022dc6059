"""Profiles: exact ones against SQL, sketched ones against the exact ones."""
from __future__ import annotations

from pyspark.sql import functions as F

from loadwarden.catalog.given import CUSTOMERS, NEW_LOAD, ORDERS, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE
from loadwarden.catalog.sql import CUSTOMERS as CUSTOMERS_SQL
from loadwarden.functions.stats import containment_from_jaccard
from loadwarden.operators import sketches
from loadwarden.operators.profile import exact_profile, load_summary, long_values, sketch_profile, top_values, value_counts

_NUMERIC = {"ORDER_ID": "order_id", "CUST_ID": "cust_id", "AMOUNT": "amount"}
_OTHER = {"ORDER_TS": ("order_ts", "TIMESTAMP_NTZ"), "STATUS": ("status", "VARCHAR"), "CHANNEL": ("channel", "VARCHAR")}
_TYPES = {"ORDER_ID": "NUMBER(19,0)", "CUST_ID": "NUMBER(19,0)", "AMOUNT": "NUMBER(12,2)"}


def _numeric_sql(name: str, col: str) -> str:
    d = f"CAST({col} AS DOUBLE)"
    return f"""SELECT 'lake.raw.orders' AS table_fqn, _load_id AS load_id, '{name}' AS column_name, '{_TYPES[name]}' AS data_type,
  count(*) AS row_count, count(*) FILTER ({col} IS NULL) / count(*) AS null_rate, count(DISTINCT {col}) AS distinct_count,
  round(avg({d}), 4) AS num_mean, round(median({d}), 6) AS num_median, round(quantile_cont({d}, 0.05), 6) AS num_p05,
  round(quantile_cont({d}, 0.95), 6) AS num_p95, min({d}) AS num_min, max({d}) AS num_max FROM bronze GROUP BY _load_id"""


def _other_sql(name: str, col: str, dtype: str) -> str:
    nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in
                        ("num_mean", "num_median", "num_p05", "num_p95", "num_min", "num_max"))
    return f"""SELECT 'lake.raw.orders' AS table_fqn, _load_id AS load_id, '{name}' AS column_name, '{dtype}' AS data_type,
  count(*) AS row_count, count(*) FILTER ({col} IS NULL) / count(*) AS null_rate, count(DISTINCT {col}) AS distinct_count,
  {nothing} FROM bronze GROUP BY _load_id"""


PROFILE_SQL = " UNION ALL ".join([_numeric_sql(n, c) for n, c in _NUMERIC.items()]
                                 + [_other_sql(n, c, t) for n, (c, t) in _OTHER.items()])


@query("profile_columns", f"WITH {BRONZE} {PROFILE_SQL}")
def profile_columns(g: Given):
    p = exact_profile(long_values(g.orders, ORDERS)).drop("top_k")
    return p.withColumns({"num_mean": F.round("num_mean", 4),
                          **{c: F.round(c, 6) for c in ("num_median", "num_p05", "num_p95")}})


@query("profile_topk", f"""WITH {BRONZE}, {CUSTOMERS_SQL},
vals AS (
  SELECT 'lake.raw.orders' AS table_fqn, _load_id AS load_id, 'STATUS' AS column_name, status AS value FROM bronze
  UNION ALL SELECT 'lake.raw.orders', _load_id, 'CHANNEL', channel FROM bronze
  UNION ALL SELECT 'lake.raw.customers', _load_id, 'SEGMENT', segment FROM bronze_customers
  UNION ALL SELECT 'lake.raw.customers', _load_id, 'CITY', city FROM bronze_customers),
top AS (SELECT *, row_number() OVER (PARTITION BY table_fqn, load_id, column_name ORDER BY n DESC, value) AS rank
        FROM (SELECT table_fqn, load_id, column_name, value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL)
        QUALIFY rank <= 20)
SELECT table_fqn, load_id, column_name, value, n, rank,
       n / sum(n) OVER (PARTITION BY table_fqn, load_id, column_name) AS share FROM top""")
def profile_topk(g: Given):
    long = long_values(g.orders, ORDERS).unionByName(long_values(g.customers, CUSTOMERS))
    return top_values(value_counts(long.where(F.col("family").isin("text", "boolean"))))


@query("load_summary", f"""WITH {BRONZE}
SELECT _load_id AS load_id, count(*) AS row_count, round(median(CAST(amount AS DOUBLE)), 0) AS median_value
FROM bronze GROUP BY 1""")
def orders_load_summary(g: Given):
    return load_summary(g.orders, "amount")


_EXACT_SQL = " UNION ALL ".join(
    f"SELECT _load_id AS load_id, '{n}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS exact_distinct, "
    f"true AS distinct_close, true AS median_close, true AS null_rate_equal FROM bronze GROUP BY 1"
    for n, c in {**_NUMERIC, **{n: c for n, (c, _) in _OTHER.items()}}.items())


@query("profile_sketch", f"WITH {BRONZE} {_EXACT_SQL}")
def profile_sketch(g: Given):
    """The one-pass sketch profile beside the exact one: distinct counts within 5 %, medians within 3 % of the rank scale."""
    sketch = sketch_profile(g.orders, ORDERS).alias("s")
    exact = exact_profile(long_values(g.orders, ORDERS)).alias("e")
    spread = F.col("e.num_max") - F.col("e.num_min")
    return sketch.join(exact, ["table_fqn", "load_id", "column_name"]).select(
        "load_id", "column_name", F.col("s.row_count").alias("row_count"), F.col("e.distinct_count").alias("exact_distinct"),
        (F.abs(F.col("s.distinct_count") - F.col("e.distinct_count")) <= 0.05 * F.col("e.distinct_count") + 1).alias("distinct_close"),
        F.coalesce(F.abs(F.col("s.num_median") - F.col("e.num_median")) <= 0.03 * spread, F.lit(True)).alias("median_close"),
        (F.abs(F.col("s.null_rate") - F.col("e.null_rate")) < 1e-12).alias("null_rate_equal"))


@query("hll_union", f"""WITH {BRONZE}
SELECT column_name, count(DISTINCT v) AS exact_distinct, true AS close FROM (
  SELECT 'ORDER_ID' AS column_name, CAST(order_id AS VARCHAR) AS v FROM bronze
  UNION ALL SELECT 'CUST_ID', CAST(cust_id AS VARCHAR) FROM bronze
  UNION ALL SELECT 'AMOUNT', CAST(amount AS VARCHAR) FROM bronze
  UNION ALL SELECT 'ORDER_TS', CAST(order_ts AS VARCHAR) FROM bronze
  UNION ALL SELECT 'STATUS', status FROM bronze UNION ALL SELECT 'CHANNEL', channel FROM bronze) GROUP BY 1""")
def hll_union(g: Given):
    """Distinct counts over all loads together, from stored per-load sketches, beside the exact counts."""
    merged = sketches.merge_hll(sketch_profile(g.orders, ORDERS), ["column_name"])
    exact = (value_counts(long_values(g.orders, ORDERS)).where(F.col("value").isNotNull())
             .groupBy("column_name", "value").agg(F.sum("n").alias("n"))
             .groupBy("column_name").agg(F.count("value").alias("exact_distinct")))
    return exact.join(merged, "column_name").select("column_name", "exact_distinct", (
        F.abs(F.col("distinct_count") - F.col("exact_distinct")) <= 0.05 * F.col("exact_distinct") + 1).alias("close"))


# each column of the new load against the same column of the baseline
CONTAINMENT_SQL = f"""WITH {BRONZE},
vals AS (
  SELECT DISTINCT _load_id >= 'L2001' AS is_new, column_name, v FROM (
    SELECT _load_id, 'ORDER_ID' AS column_name, CAST(order_id AS VARCHAR) AS v FROM bronze
    UNION ALL SELECT _load_id, 'CUST_ID', CAST(cust_id AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'AMOUNT', CAST(amount AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'ORDER_TS', CAST(order_ts AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'CHANNEL', channel FROM bronze
    UNION ALL SELECT _load_id, 'STATUS', status FROM bronze))
SELECT n.column_name, count(b.v) / count(*) AS exact, true AS close
FROM vals n LEFT JOIN vals b ON NOT b.is_new AND b.column_name = n.column_name AND b.v = n.v
WHERE n.is_new GROUP BY 1"""


def _self_pairs(g: Given):
    names = ["ORDER_ID", "CUST_ID", "ORDER_TS", "AMOUNT", "CHANNEL", "STATUS"]
    rows = [(ORDERS, NEW_LOAD, n, n) for n in names]
    return g.spark.createDataFrame(rows, "table_fqn string, load_id string, column_before string, column_after string")


def _exact_containment(g: Given):
    long = long_values(g.orders, ORDERS)
    values = value_counts(long).where(F.col("value").isNotNull())
    per = values.groupBy("column_name", "value").agg(
        F.max(F.col("load_id") >= NEW_LOAD).alias("new"), F.max(F.col("load_id") < NEW_LOAD).alias("old"))
    return per.where("new").groupBy(F.col("column_name").alias("column_before")).agg(
        (F.count_if("old") / F.count(F.lit(1))).alias("exact"))


def _close(estimates, g: Given, tolerance: float):
    return estimates.join(_exact_containment(g), "column_before").select(
        F.col("column_before").alias("column_name"), "exact",
        (F.abs(F.col("containment") - F.col("exact")) <= tolerance).alias("close"))


@query("theta_containment", CONTAINMENT_SQL)
def theta_containment(g: Given):
    profiles = sketch_profile(g.orders, ORDERS)
    loads = profiles.select("table_fqn", F.lit(NEW_LOAD).alias("load_id"), F.col("load_id").alias("base_load_id")).distinct()
    base = loads.where(F.col("base_load_id") < NEW_LOAD)
    return _close(sketches.pair_theta_containment(_self_pairs(g), base, profiles), g, 0.05)


JACCARD_SQL = f"""WITH {BRONZE},
vals AS (
  SELECT column_name, v, bool_or(_load_id >= 'L2001') AS n, bool_or(_load_id < 'L2001') AS o FROM (
    SELECT _load_id, 'ORDER_ID' AS column_name, CAST(order_id AS VARCHAR) AS v FROM bronze
    UNION ALL SELECT _load_id, 'CUST_ID', CAST(cust_id AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'AMOUNT', CAST(amount AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'ORDER_TS', CAST(order_ts AS VARCHAR) FROM bronze
    UNION ALL SELECT _load_id, 'CHANNEL', channel FROM bronze
    UNION ALL SELECT _load_id, 'STATUS', status FROM bronze) GROUP BY ALL)
SELECT column_name, count(*) FILTER (n AND o) / count(*) AS jaccard, count(*) FILTER (n AND o) / count(*) FILTER (n) AS exact,
       true AS jaccard_close, true AS consistent FROM vals GROUP BY 1"""


@query("minhash_containment", JACCARD_SQL)
def minhash_containment(g: Given):
    """64 hashes estimate a Jaccard similarity within three standard errors (0.19 at most); with the exact
    similarity and the exact sizes, the containment formula gives the exact containment."""
    long = long_values(g.orders, ORDERS)
    is_new = F.col("load_id") >= NEW_LOAD
    states = sketches.minhash_states(long).withColumn("is_new", is_new)
    merged = sketches.merge_minhash(states, ["column_name", "is_new"])
    old, new = (merged.where(F.col("is_new") == flag).select("column_name", F.col("minhash").alias(name))
                for flag, name in ((False, "_old"), (True, "_new")))
    estimate = old.join(new, "column_name").select("column_name", sketches.jaccard(F.col("_old"), F.col("_new")).alias("_estimate"))
    values = value_counts(long).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.max(is_new).alias("n"), F.max(~is_new).alias("o"))
    exact = values.groupBy("column_name").agg(
        (F.count_if(F.col("n") & F.col("o")) / F.count(F.lit(1))).alias("jaccard"),
        (F.count_if(F.col("n") & F.col("o")) / F.count_if("n")).alias("exact"),
        F.count_if("o").cast("double").alias("_n_old"), F.count_if("n").cast("double").alias("_n_new"))
    derived = containment_from_jaccard(F.col("jaccard"), F.col("_n_old"), F.col("_n_new"))
    return exact.join(estimate, "column_name").select(
        "column_name", "jaccard", "exact", (F.abs(F.col("_estimate") - F.col("jaccard")) <= 0.19).alias("jaccard_close"),
        (F.abs(derived - F.col("exact")) < 1e-9).alias("consistent"))
