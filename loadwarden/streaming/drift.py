"""Numeric drift on a stream: quantile sketches of closed windows, and a ring of the windows before as keyed state.

A window of a column is one mergeable sketch, built by partial aggregation, so a hot column sends one small state per task. Once the watermark closes a window, its
sketch enters the ring of its column, which holds the last RING windows and no rows, and leaves together with the ring as it was before. Medians, their median and
the robust distance are taken from the sketches with plain column functions.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadwarden.functions.stats import array_median, robust_z
from loadwarden.streaming.closing import STATE_STORE

#: Windows that form a baseline.
RING = 7


def window_sketches(events: DataFrame, time: str, column: str, value: str, width: str, delay: str) -> DataFrame:
    """w, column, n (values), sketch of every window that is closed; null values do not count, and a window without values has no row."""
    return (events.select(F.col(time).cast("timestamp").alias("_t"), F.col(column).cast("string").alias("column"), F.col(value).cast("double").alias("_v"))
            .where("_v IS NOT NULL").withWatermark("_t", delay).groupBy(F.window("_t", width).alias("w"), "column")
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v").alias("sketch")))


class WindowRing(StatefulProcessor):
    """Keeps the sketches of the last windows of a column and gives each window the ring from before it."""

    def __init__(self, ring: int = RING):
        self.ring = ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "sketch binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("start")
        held = [bytes(r[0]) for r in self.held.get()]
        out = []
        for start, n, sketch in zip(found["start"], found["n"], found["sketch"]):
            out.append((key[0], start, int(n), bytes(sketch), list(held)))
            held = [*held, bytes(sketch)][-self.ring:]
        self.held.put([(s,) for s in held])
        yield pd.DataFrame(out, columns=["column", "start", "n", "sketch", "before"])

    def close(self) -> None:
        pass


def with_ring(windows: DataFrame, ring: int = RING) -> DataFrame:
    """column, start, n, sketch and the sketches of up to `ring` closed windows of the column before it."""
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = windows.select("column", F.col("w.start").alias("start"), "n", "sketch")
    return rows.groupBy("column").transformWithStateInPandas(
        WindowRing(ring), "column string, start timestamp, n bigint, sketch binary, before array<binary>", outputMode="append", timeMode="None")


def numeric_drift(rings: DataFrame, thresholds: dict) -> DataFrame:
    """Per closed window and column with enough of a baseline: n, median, baseline_windows, baseline_median, the median over all baseline
    values (from the merged sketches), factor, robust_z, flagged."""
    median = lambda s: F.kll_sketch_get_quantile_double(s, F.lit(0.5))
    usable = F.filter(F.transform("before", median), lambda m: m != 0)
    merged = F.aggregate(F.slice("before", 2, RING), F.element_at("before", 1), lambda a, s: F.kll_sketch_merge_double(a, s))
    rows = (rings.where(F.size("before") >= thresholds["semantic_min_loads"])
            .select("column", "start", "n", median(F.col("sketch")).alias("median"), usable.alias("_medians"), median(merged).alias("pooled_median")))
    rows = rows.where((F.size("_medians") >= thresholds["semantic_min_loads"]) & (F.col("median") != 0))
    base = array_median(F.array_sort("_medians"))
    ratio = F.try_divide(base, F.col("median"))
    rows = rows.select("column", "start", "n", "median", F.size("_medians").alias("baseline_windows"), base.alias("baseline_median"), "pooled_median",
                       F.when(ratio != 0, F.greatest(ratio, F.try_divide(F.lit(1.0), ratio))).alias("factor"), robust_z(F.col("median"), F.col("_medians")).alias("robust_z"))
    return rows.withColumn("flagged", F.coalesce((F.col("factor") >= thresholds["semantic_min_factor"])
                                                 & (F.col("robust_z") >= thresholds["semantic_min_robust_z"]), F.lit(False)))
