"""Staging models and marts."""
from __future__ import annotations

from pyspark.sql import functions as F

from loadwarden.catalog.given import CUSTOMER_COLUMNS, CUSTOMERS, ORDER_COLUMNS, ORDERS, Given
from loadwarden.catalog.registry import query
from loadwarden.catalog.sql import STAGING
from loadwarden.operators.gate import passed_loads
from loadwarden.operators.staging import misfits, staging
from loadwarden.plans import marts
from loadwarden.session import write_through


def stg_orders(g: Given):
    return staging(g.orders, ORDERS, passed_loads(g.live_gate), ORDER_COLUMNS, "order_id")


def stg_customers(g: Given):
    return staging(g.customers, CUSTOMERS, passed_loads(g.live_gate), CUSTOMER_COLUMNS, "cust_id")


def fct(g: Given):
    return marts.fct_orders(stg_orders(g), stg_customers(g))


def _plain(df, **money):
    """Keys as bigint and money as double, so that both engines print the same values."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("order_id", "cust_id") if c in df.columns} | {
        c: F.round(F.col(c).cast("double"), n) for c, n in money.items()})


@query("staging_orders", f"""WITH {STAGING}
SELECT order_id, cust_id, order_ts, CAST(amount AS DOUBLE) AS amount, status, channel, _load_id, _loaded_at
FROM stg_orders""")
def staging_orders(g: Given):
    return _plain(stg_orders(g), amount=2)


@query("staging_customers", f"WITH {STAGING} SELECT cust_id, segment, city, signup_date, _load_id, _loaded_at FROM stg_customers")
def staging_customers(g: Given):
    return _plain(stg_customers(g))


@query("fct_orders", f"""WITH {STAGING}
SELECT order_id, cust_id, segment, city, order_ts, order_date, CAST(amount AS DOUBLE) AS amount, status, channel FROM fct""")
def fct_orders(g: Given):
    return _plain(fct(g), amount=2)


@query("dim_customers", f"""WITH {STAGING}
SELECT c.cust_id, c.segment, c.city, c.signup_date, count(o.order_id) AS lifetime_orders,
       CAST(min(o.order_ts) AS DATE) AS first_order_date, CAST(max(o.order_ts) AS DATE) AS last_order_date
FROM stg_customers c LEFT JOIN stg_orders o USING (cust_id) GROUP BY ALL""")
def dim_customers(g: Given):
    return _plain(marts.dim_customers(stg_customers(g), stg_orders(g)))


@query("customer_ltv", f"""WITH {STAGING}
SELECT cust_id, segment, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS ltv,
       CAST(sum(amount) AS DOUBLE) / count(*) AS avg_order_value
FROM fct WHERE status = 'C' GROUP BY cust_id, segment""")
def customer_ltv(g: Given):
    return _plain(marts.customer_ltv(fct(g)), ltv=2)


@query("revenue_daily", f"""WITH {STAGING}
SELECT order_date, channel, segment, count(*) AS orders, CAST(sum(amount) AS DOUBLE) AS revenue,
       round(median(CAST(amount AS DOUBLE)), 6) AS median_order
FROM fct WHERE status = 'C' GROUP BY order_date, channel, segment""")
def revenue_daily(g: Given):
    return _plain(marts.revenue_daily(write_through(fct(g), "fct-orders")), revenue=2, median_order=6)


@query("finance_kpis", f"""WITH {STAGING}
SELECT order_date, CAST(sum(amount) AS DOUBLE) AS gmv, count(*) AS orders,
       CAST(sum(amount) AS DOUBLE) / nullif(count(*), 0) AS aov
FROM fct WHERE status = 'C' GROUP BY order_date""")
def finance_kpis(g: Given):
    return _plain(marts.finance_kpis(marts.daily_sums(fct(g))), gmv=2)


_NARROW = [{**c, "type": {"amount": "number(8,2)", "order_id": "number(3,0)"}.get(c["alias"], c["type"])} for c in ORDER_COLUMNS]


@query("contract_misfits", f"""WITH {STAGING},
n AS (SELECT _load_id AS load_id, count(*) AS row_count, count(*) FILTER (abs(order_id) > 999) AS order_id,
        0::BIGINT AS cust_id, 0::BIGINT AS order_ts, count(*) FILTER (abs(amount) > 999999.99) AS amount,
        0::BIGINT AS status, 0::BIGINT AS channel FROM bronze GROUP BY 1)
SELECT load_id, row_count, column_name, misfits FROM n UNPIVOT INCLUDE NULLS
  (misfits FOR column_name IN (order_id, cust_id, order_ts, amount, status, channel))""")
def contract_misfits(g: Given):
    """Rows that a narrower contract could not hold, before an enforced cast fails on them."""
    return misfits(g.orders, _NARROW)
