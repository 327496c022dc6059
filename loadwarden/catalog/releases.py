"""Releases over the given tables: versions of models, the gate beside them, and approvals that are used up."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loadwarden.catalog.given import CUSTOMER_COLUMNS, CUSTOMERS, NEW_LOAD, ORDER_COLUMNS, ORDERS, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import BRONZE, CUSTOMERS as CUSTOMERS_SQL
from loadwarden.operators import quality
from loadwarden.operators.gate import gate_latest, passed_loads, request_order
from loadwarden.operators.staging import staging
from loadwarden.plans import marts
from loadwarden.plans.rebuild import Model, published
from loadwarden.plans.release import approve, release_models
from loadwarden.session import scratch_path
from loadwarden.sources.control import ControlPlane

INCIDENT = "INC-HELD"


def models(g: Given, strict: bool = False) -> dict[str, Model]:
    """Staging models and marts; `strict` has a test that fails as soon as a customer orders twice."""
    def stg(rows, table, columns, key):
        return lambda log: staging(rows, table, passed_loads(gate_latest(log)), columns, key)

    def facts(df):
        return [quality.not_null_tests(df, "fct_orders", ["order_id", "cust_id"]), quality.unique_test(df, "fct_orders", "cust_id" if strict else "order_id")]

    return {
        "stg_orders": Model((), stg(g.orders, ORDERS, ORDER_COLUMNS, "order_id"), lambda df: [quality.unique_test(df, "stg_orders", "order_id")]),
        "stg_customers": Model((), stg(g.customers, CUSTOMERS, CUSTOMER_COLUMNS, "cust_id"), lambda df: [quality.unique_test(df, "stg_customers", "cust_id")]),
        "fct_orders": Model(("stg_orders", "stg_customers"), marts.fct_orders, facts),
        "dim_customers": Model(("stg_customers", "stg_orders"), marts.dim_customers, lambda df: [quality.unique_test(df, "dim_customers", "cust_id")]),
        "customer_ltv": Model(("fct_orders",), marts.customer_ltv),
        "daily_sums": Model(("fct_orders",), marts.daily_sums),
        "finance_kpis": Model(("daily_sums",), marts.finance_kpis),
    }


def edges(spark, of: dict[str, Model]):
    return spark.createDataFrame([(f"model.shop.{p}", f"model.shop.{m}") for m, x in of.items() for p in x.reads], "src string, dst string")


def _control(g: Given) -> ControlPlane:
    """All loads but the new one have passed; the new one is held, its incident open."""
    control = ControlPlane(g.spark, scratch_path(g.spark, "release-control"))
    start = datetime(2002, 1, 1)
    held = (F.col("table_fqn") == ORDERS) & (F.col("load_id") == NEW_LOAD)
    control.append("gate_log", g.observed.select(
        F.lit(request_order(start, 0)).alias("seq"), "table_fqn", "load_id", F.when(held, "QUARANTINED").otherwise("PASSED").alias("status"),
        F.when(held, INCIDENT).alias("incident_id"), F.lit("trial").alias("decided_by"), F.lit(start).alias("decided_at"), "row_count", F.lit(False).alias("approved")))
    fields = control.read("incident_log").columns
    row = {"seq": 0, "at": start, "incident_id": INCIDENT, "table_fqn": ORDERS, "load_id": NEW_LOAD, "top_class": "semantic", "status": "OPEN"}
    control.append("incident_log", g.spark.createDataFrame([tuple(row.get(f) for f in fields)], control.read("incident_log").schema))
    return control


_MODELS = """stg AS (SELECT * FROM bronze WHERE _load_id < 'L2001' OR {all_loads}
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _loaded_at DESC, _load_id DESC) = 1)
SELECT 'stg_orders' AS model, count(*) AS n FROM stg UNION ALL SELECT 'fct_orders', count(*) FROM stg
UNION ALL SELECT 'dim_customers', count(*) FROM bronze_customers
UNION ALL SELECT 'customer_ltv', count(*) FROM (SELECT DISTINCT cust_id FROM stg WHERE status = 'C')
UNION ALL SELECT 'daily_sums', count(DISTINCT CAST(order_ts AS DATE)) FROM stg WHERE status = 'C'
UNION ALL SELECT 'finance_kpis', count(DISTINCT CAST(order_ts AS DATE)) FROM stg WHERE status = 'C'"""


@query("release_results", f"""WITH {BRONZE}, {CUSTOMERS_SQL},
first AS (WITH {_MODELS.format(all_loads="false")} UNION ALL SELECT 'stg_customers', count(*) FROM bronze_customers),
later AS (WITH {_MODELS.format(all_loads="true")}),
twice AS (SELECT count(*) AS n FROM (SELECT 1 FROM bronze GROUP BY cust_id HAVING count(DISTINCT order_id) > 1)),
runs AS (
  SELECT 1 AS run, model, n, 0 AS failures FROM first
  UNION ALL SELECT 2, model, n, CASE model WHEN 'fct_orders' THEN (SELECT n FROM twice) ELSE 0 END FROM later
  UNION ALL SELECT 4, model, n, 0 FROM later)
SELECT run, model, n AS row_count, CAST(failures AS BIGINT) AS failures, run <> 2 AS published, run = 4 OR model = 'stg_customers' AS serves,
       CASE WHEN run = 4 THEN 'PASSED' ELSE 'QUARANTINED' END AS status FROM runs""")
def release_results(g: Given):
    """First every model is built. Then the held load is approved, but a test fails: nothing is published, the load stays held and the approval is used
    up, so the third run, without a new word, has no load to release and finds nothing to build. A new word releases it. Only models downstream of the load are made
    anew; the last column says what the gate held after the run."""
    spark, control = g.spark, _control(g)
    given = models(g)
    lineage = edges(spark, given)
    states = []
    for run, (word, strict) in enumerate(((False, False), (True, True), (False, False), (True, False)), 1):
        at = datetime(2002, 1, 1 + run)
        if word:
            approve(control, INCIDENT, "someone", at.replace(hour=1))
        release_models(control, None, models(g, strict), g.column_map, lineage, at.replace(hour=2))
        states.append((f"REL-{int(at.replace(hour=2).timestamp() * 1_000_000)}", run,
                       gate_latest(control.read("gate_log")).where(F.col("load_id") == NEW_LOAD).first()["status"]))
    runs = spark.createDataFrame(states, "release_id string, run int, status string")
    now = published(control).select("model", F.col("version").alias("_now"))
    return (control.read("release_results").join(runs, "release_id").join(now, "model")
            .select("run", "model", "row_count", "failures", "published", (F.col("version") == F.col("_now")).alias("serves"), "status"))
