"""Marts over the staging models."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.operators.quantiles import exact_quantiles

COMPLETED = "C"


def fct_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with customer attributes. A customer with very many orders is split by the adaptive skew join."""
    c = customers.select("cust_id", "segment", "city")
    return orders.join(c, "cust_id", "left").select(
        "order_id", "cust_id", "segment", "city", "order_ts", F.col("order_ts").cast("date").alias("order_date"),
        "amount", "status", "channel")


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their order history; orders are reduced to one row per customer before the join."""
    history = orders.groupBy("cust_id").agg(
        F.count("order_id").alias("lifetime_orders"), F.min("order_ts").cast("date").alias("first_order_date"),
        F.max("order_ts").cast("date").alias("last_order_date"))
    return customers.select("cust_id", "segment", "city", "signup_date").join(history, "cust_id", "left").withColumn(
        "lifetime_orders", F.coalesce("lifetime_orders", F.lit(0)))


def customer_ltv(fct: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return fct.where(F.col("status") == COMPLETED).groupBy("cust_id", "segment").agg(
        n.alias("orders"), F.sum("amount").alias("ltv"),
        (F.sum("amount").cast("double") / n).alias("avg_order_value"))


def revenue_daily(fct: DataFrame) -> DataFrame:
    """Orders, revenue and exact median order by day, channel and segment; no group is sorted whole."""
    keys = ["order_date", "channel", "segment"]
    done = fct.where(F.col("status") == COMPLETED)
    return exact_quantiles(done, keys, "amount", {"median_order": 0.5},
                           totals={"orders": F.lit(1), "revenue": F.col("amount")})


def daily_sums(fct: DataFrame) -> DataFrame:
    """Orders and revenue of a day: all that the key figures need of the daily mart, in one partial aggregate."""
    return fct.where(F.col("status") == COMPLETED).groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("revenue"))


def finance_kpis(daily: DataFrame) -> DataFrame:
    orders = F.sum("orders")
    return daily.groupBy("order_date").agg(
        F.sum("revenue").alias("gmv"), orders.alias("orders"),
        F.try_divide(F.sum("revenue").cast("double"), orders).alias("aov"))


# model -> (models it reads, builder)
MODELS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "fct_orders": (("stg_orders", "stg_customers"), fct_orders),
    "dim_customers": (("stg_customers", "stg_orders"), dim_customers),
    "customer_ltv": (("fct_orders",), customer_ltv),
    "fct_revenue_daily": (("fct_orders",), revenue_daily),
    "mart_finance_kpis": (("fct_revenue_daily",), finance_kpis),
}


def build(staged: dict[str, DataFrame], wanted: set[str] | None = None) -> dict[str, DataFrame]:
    """Lazy marts over the given staging models; `wanted` restricts what is returned (an affected-only rebuild)."""
    done = dict(staged)
    for name, (parents, builder) in MODELS.items():
        done[name] = builder(*[done[p] for p in parents])
    return {n: df for n, df in done.items() if n in MODELS and (wanted is None or n in wanted)}
