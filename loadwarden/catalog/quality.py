"""Data tests, credential scan and bronze audit."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.catalog.given import Given
from loadwarden.catalog.models import stg_customers, stg_orders
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE, STAGING
from loadwarden.operators import quality
from loadwarden.operators.audit_tree import audit_tree, changed_rows, differing_branches
from loadwarden.plans.marts import dim_customers, fct_orders
from loadwarden.session import write_through
from loadwarden.sources.build_results import build_summary


def model_test_rows(g: Given):
    # each model is built once, as the table it is, and then tested
    orders, customers = write_through(stg_orders(g), "stg-orders"), write_through(stg_customers(g), "stg-customers")
    facts = write_through(fct_orders(orders, customers), "fct-orders")
    # only customers of two segments, so that the relationship test has something to find
    some = customers.where(F.col("segment").isin("BUILDING", "MACHINERY"))
    parts = [
        quality.not_null_tests(orders, "stg_orders", ["order_id", "cust_id", "order_ts", "amount", "status"]),
        quality.unique_test(orders, "stg_orders", "order_id"), quality.unique_test(customers, "stg_customers", "cust_id"),
        quality.not_null_tests(customers, "stg_customers", ["cust_id"]),
        quality.not_null_tests(facts, "fct_orders", ["order_id", "cust_id"]), quality.unique_test(facts, "fct_orders", "order_id"),
        quality.relationship_test(facts, "fct_orders", "cust_id", customers, "cust_id"),
        quality.relationship_test(facts, "fct_orders_two_segments", "cust_id", some, "cust_id"),
        quality.unique_test(facts, "fct_orders", "cust_id"),
        quality.unique_test(dim_customers(customers, orders), "dim_customers", "cust_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


TESTS_SQL = f"""WITH {STAGING},
tests AS (
  SELECT 'stg_orders' AS model, unnest(['order_id', 'cust_id', 'order_ts', 'amount', 'status']) AS column_name, 'not_null' AS test,
    unnest([count(*) FILTER (order_id IS NULL), count(*) FILTER (cust_id IS NULL), count(*) FILTER (order_ts IS NULL),
            count(*) FILTER (amount IS NULL), count(*) FILTER (status IS NULL)]) AS failures FROM stg_orders
  UNION ALL SELECT 'stg_orders', 'order_id', 'unique', count(*) FROM (SELECT 1 FROM stg_orders GROUP BY order_id HAVING count(*) > 1)
  UNION ALL SELECT 'stg_customers', 'cust_id', 'unique', count(*) FROM (SELECT 1 FROM stg_customers GROUP BY cust_id HAVING count(*) > 1)
  UNION ALL SELECT 'stg_customers', 'cust_id', 'not_null', count(*) FROM stg_customers WHERE cust_id IS NULL
  UNION ALL SELECT 'fct_orders', unnest(['order_id', 'cust_id']), 'not_null',
    unnest([count(*) FILTER (order_id IS NULL), count(*) FILTER (cust_id IS NULL)]) FROM fct
  UNION ALL SELECT 'fct_orders', 'order_id', 'unique', count(*) FROM (SELECT 1 FROM fct GROUP BY order_id HAVING count(*) > 1)
  UNION ALL SELECT 'fct_orders', 'cust_id', 'relationships', count(*) FROM fct WHERE cust_id NOT IN (SELECT cust_id FROM stg_customers)
  UNION ALL SELECT 'fct_orders_two_segments', 'cust_id', 'relationships', count(*) FROM fct
    WHERE cust_id NOT IN (SELECT cust_id FROM stg_customers WHERE segment IN ('BUILDING', 'MACHINERY'))
  UNION ALL SELECT 'fct_orders', 'cust_id', 'unique', count(*) FROM (SELECT 1 FROM fct GROUP BY cust_id HAVING count(*) > 1)
  UNION ALL SELECT 'dim_customers', 'cust_id', 'unique', count(*) FROM (SELECT 1 FROM stg_customers GROUP BY cust_id HAVING count(*) > 1))"""


@query("model_tests", f"{TESTS_SQL} SELECT * FROM tests")
def model_tests(g: Given):
    return model_test_rows(g)


@query("build_summary", f"""{TESTS_SQL}
SELECT count(DISTINCT model) AS models_built, count(*) AS tests_run, count(*) FILTER (failures > 0) AS failed FROM tests""")
def build_summaries(g: Given):
    """Build results made of the model tests: one result per model, one per test."""
    tests = model_test_rows(g).select(
        F.concat_ws(".", F.lit("test.shop"), "test", "model", "column_name").alias("unique_id"),
        F.when(F.col("failures") > 0, "fail").otherwise("pass").alias("status"), "model")
    models = tests.select(F.concat(F.lit("model.shop."), "model").alias("unique_id"), F.lit("success").alias("status")).distinct()
    return build_summary(tests.select("unique_id", "status").unionByName(models))


_PATTERNS = " UNION ALL ".join(
    f"SELECT source, count(*) AS scanned, '{n}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS hits FROM documents GROUP BY 1"
    for n, p in quality.SECRET_PATTERNS.items())


@query("secret_scan", _PATTERNS)
def secret_scan(g: Given):
    """Credential patterns over whole documents, per source."""
    return quality.secret_summary(g.table("documents"), "text", "source")


@query("bronze_audit", f"""WITH {BRONZE}
SELECT _load_id AS load_id, count(*) AS rows_before,
       CASE _load_id WHEN 'L1997' THEN count(*) FILTER (status <> 'A') WHEN 'L1999' THEN 0 ELSE count(*) END AS rows_after,
       _load_id IN ('L1996', 'L1997', 'L1998', 'L1999') AS changed FROM bronze GROUP BY 1""")
def bronze_audit(g: Given):
    """Two audits of the feed: in the second one load lost rows, one had values rewritten, one has them in another column and one is gone."""
    load = F.col("_load_id")
    amount = F.when(load == "L1998", F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(12,2)")
    later = (g.orders.where((load != "L1999") & ~((load == "L1997") & (F.col("status") == "A"))).withColumn("amount", amount))
    moved = F.when(load == "L1996", F.col("channel"))
    first = g.orders.withColumn("spare", F.lit(None).cast("string"))
    later = later.withColumns({"spare": moved, "channel": F.when(load != "L1996", F.col("channel"))})
    return quality.changed_loads(quality.load_checksums(first), quality.load_checksums(later))


@query("audit_locate", f"""WITH {BRONZE}
SELECT _load_id AS load_id, order_id, change, CASE change WHEN 'value' THEN columns ELSE '' END AS columns FROM (
  SELECT _load_id, order_id, CASE _load_id WHEN 'L1999' THEN 'missing' WHEN 'L1998' THEN 'value' WHEN 'L1997' THEN 'repeated' ELSE 'value' END AS change,
         CASE _load_id WHEN 'L1998' THEN 'amount' ELSE 'channel,spare' END AS columns
  FROM bronze WHERE _load_id = 'L1999' OR (_load_id = 'L1998' AND status = 'A') OR (_load_id = 'L1997' AND status = 'A') OR (_load_id = 'L1996' AND status = 'A'))
UNION ALL SELECT 'L1990', order_id, 'new', '' FROM bronze WHERE _load_id = 'L1995' AND status = 'A'""")
def audit_locate(g: Given):
    """Which rows and columns a second audit finds changed, by the branches of the checksum trees that differ: open orders of three loads were repriced,
    sent twice and had a value moved, one load is gone, and one has come that nobody knew."""
    load, is_open = F.col("_load_id"), F.col("status") == "A"
    first = g.orders.withColumn("spare", F.lit(None).cast("string"))
    moved = (load == "L1996") & is_open
    later = first.where(load != "L1999").withColumns({
        "amount": F.when((load == "L1998") & is_open, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(12,2)"),
        "spare": F.when(moved, F.col("channel")), "channel": F.when(~moved, F.col("channel"))})
    sent = F.when((load == "L1997") & is_open, F.array(load, load)).when((load == "L1995") & is_open, F.array(load, F.lit("L1990"))).otherwise(F.array(load))
    later = later.withColumn("_load_id", F.explode(sent))
    trees = [write_through(audit_tree(rows, "order_id"), "audit-tree") for rows in (first, later)]
    branches = write_through(differing_branches(*trees), "audit-branches")
    return changed_rows(first, later, branches, "order_id").withColumn("columns", F.array_join("columns", ","))
