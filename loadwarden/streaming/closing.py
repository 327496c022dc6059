"""When a load of a stream is complete: state with a timer per load, and the hand-over of closed loads to the scan.

Rows of a load may be spread over many micro-batches. A map without shuffle first reduces them to one row per load and Arrow batch, so what is shuffled and
enters the state grows with the loads and not with their rows. The state of a load is its row count and its last row's time; a timer runs out once the watermark has
passed that time by the quiet period, and every further row sets it anew. The closed load is emitted once and its state dropped. Should a load go on after that,
it is closed again, with the rows that came later, and the scan knows it by its gate row.
"""
from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadwarden.operators.gate import gate_latest
from loadwarden.plans.scan import Lineage, WatchedTable, scan
from loadwarden.policy import Policy
from loadwarden.session import write_through
from loadwarden.sources.control import ControlPlane
from loadwarden.streaming.watch import run_available

#: The state store that timers and typed state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by("load_id").aggregate([("at", "max"), ("at", "count")])
            yield pa.RecordBatch.from_arrays([found["load_id"].combine_chunks(), found["at_max"].combine_chunks(),
                                              pc.cast(found["at_count"], pa.int64()).combine_chunks()], names=["load_id", "at", "rows"])


class LoadCloser(StatefulProcessor):
    """Counts the rows of a load and emits it when it has been quiet for long enough, in event time."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, last = self.seen.get() if self.seen.exists() else (0, 0)
        for some in rows:
            count += int(some["rows"].sum())
            last = max(last, int((some["at"].max() - _EPOCH) / timedelta(milliseconds=1)))
        self.seen.update((count, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.quiet_ms)
        yield pd.DataFrame({"load_id": pd.Series(dtype="str"), "row_count": pd.Series(dtype="int64"), "last_at": pd.Series(dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, last = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"load_id": [key[0]], "row_count": [count], "last_at": [_EPOCH + timedelta(milliseconds=last)]})

    def close(self) -> None:
        pass


def closed_loads(stream: DataFrame, load: Column, at: str, quiet: str, delay: str) -> DataFrame:
    """load_id, row_count, last_at of every load of the stream, once no row of it has come for `quiet` (event time, rows being late by up to `delay`)."""
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    # rows without an id or a time belong to no load
    timed = stream.select(load.cast("string").alias("load_id"), F.col(at).cast("timestamp").alias("at")).where("load_id IS NOT NULL AND at IS NOT NULL")
    parts = timed.mapInArrow(_reduced, "load_id string, at timestamp, rows bigint").withWatermark("at", delay)
    return parts.groupBy("load_id").transformWithStateInPandas(
        LoadCloser(quiet_ms), "load_id string, row_count bigint, last_at timestamp", outputMode="append", timeMode="EventTime")


def scan_closed(spark: SparkSession, stream: DataFrame, load: Column, at: str, watched: WatchedTable, control: ControlPlane, lineage: Lineage, policy: Policy,
                root: str, when: datetime, quiet: str, delay: str, mode: str = "protect") -> None:
    """Runs the stream to the end of what has arrived and hands every load to `scan` as it closes; a later call goes on from the checkpoint.

    A micro-batch that is replayed after a crash hands its loads over again; those that the gate has decided are no-ops for the scan, and one it had
    begun is taken up again, so each load is decided once.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        gate = gate_latest(control.read("gate_log")).where(F.col("status") != "PENDING").select("table_fqn", "load_id")
        closed = batch.select(F.lit(watched.table).alias("table_fqn"), "load_id")
        ready = write_through(closed.join(gate, ["table_fqn", "load_id"], "left_anti"), "closed-loads")
        if not ready.isEmpty():
            scan(control, [watched], lineage, policy, when, mode, only=ready)

    run_available(closed_loads(stream, load, at, quiet, delay), hand_over, f"{root}/closing")
