"""Exact interpolated quantiles that never gather a whole group into one task.

Spark's own `median`/`percentile` hold every distinct value of a group in one task. Here a mergeable
sketch first brackets the wanted ranks; the rows outside the brackets shrink to one counted row per
gap before the shuffle, and only the thin brackets (a few ranks in `accuracy`) are sorted per group.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def bracket_points(probs: dict[str, float], accuracy: int = ACCURACY) -> list[float]:
    """Two ranks per probability, beyond the sketch's error on either side."""
    eps = 2.0 / accuracy
    return [p for prob in sorted(probs.values()) for p in (max(prob - eps, 0.0), min(prob + eps, 1.0))]


def brackets(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float],
             accuracy: int = ACCURACY) -> DataFrame:
    """Per group: two values per probability that enclose its exact rank."""
    points = bracket_points(probs, accuracy)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(p) for p in points]),
                            F.lit(accuracy)).alias("_brackets"))


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, reduce(Column.__and__, same), how).drop(*[f"_r_{k}" for k in keys])


def quantiles_within(counted: DataFrame, bounds: DataFrame, keys: list[str], value: str,
                     probs: dict[str, float], weight: str | None = None,
                     totals: dict[str, Column] | None = None) -> DataFrame:
    """Exact quantiles of weighted values, given brackets of the same groups.

    `totals` are summed over all rows of a group in the same pass, rows without a value included; with totals a
    group that has no values at all is kept, its quantiles null.
    """
    names = sorted(probs, key=probs.get)
    totals = totals or {}
    v, known = F.col("_v"), F.col(value).isNotNull()
    rows = (counted if totals else counted.where(known)).select(
        *keys, F.col(value).cast("double").alias("_v"),
        F.when(known, F.col(weight) if weight else F.lit(1)).otherwise(0).cast("bigint").alias("_w"),
        *[c.alias(n) for n, c in totals.items()])
    joined = _join_on(rows, bounds, keys, "left" if totals else "inner")
    spans = [(F.col("_brackets")[2 * i], F.col("_brackets")[2 * i + 1]) for i in range(len(names))]
    inside = reduce(Column.__or__, [v.between(lo, hi) for lo, hi in spans])
    gap = reduce(Column.__add__, [(v > hi).cast("int") for _, hi in spans])
    shrunk = (
        joined.groupBy(*keys, gap.alias("_gap"), F.when(inside, v).alias("_point"))
        .agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[F.sum(n).alias(n) for n in totals])
    )
    group = Window.partitionBy(*keys)
    running = group.orderBy("_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = shrunk.select("*", F.sum("_w").over(running).alias("_upto"), F.sum("_w").over(group).alias("_n"))
    first, last = F.col("_upto") - F.col("_w"), F.col("_upto") - 1

    def at(rank: Column) -> Column:
        edge = (F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when(rank == first, F.col("_lo"))
                .when(rank == last, F.col("_hi"))
                .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")))
        return F.max(F.when((rank >= first) & (rank <= last), edge))

    aggs = []
    for i, name in enumerate(names):
        pos = (F.col("_n") - 1) * F.lit(float(probs[name]))
        aggs += [at(F.floor(pos)).alias(f"_low{i}"), at(F.ceil(pos)).alias(f"_high{i}")]
    picked = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs, *[F.sum(n).alias(n) for n in totals])
    out = []
    for i, name in enumerate(names):
        pos = (F.col("_n") - 1) * F.lit(float(probs[name]))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *totals, *out)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    accuracy: int = ACCURACY, totals: dict[str, Column] | None = None) -> DataFrame:
    """keys, the totals, and one double column per named probability; without totals, groups without values are
    left out."""
    bounds = brackets(rows, keys, value, probs, accuracy)
    return quantiles_within(rows, bounds, keys, value, probs, totals=totals)


def with_quantiles(grouped: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Attach quantile columns to an aggregate of the same groups, nulls where a group has no values."""
    renamed = quantiles.select(*[F.col(k).alias(f"_q_{k}") for k in keys],
                               *[c for c in quantiles.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys]
    return grouped.join(renamed, reduce(Column.__and__, same), "left").drop(*[f"_q_{k}" for k in keys])
