"""Loads of a stream close by their timers and are scanned once, over several micro-batches and a restart."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loadwarden.operators.gate import gate_latest
from loadwarden.plans.scan import Lineage, WatchedTable, bootstrap, scan
from loadwarden.policy import Policy
from loadwarden.sources.control import ControlPlane
from loadwarden.sources.lineage import lineage_tables
from loadwarden.sources.registry import column_map
from loadwarden.streaming.closing import closed_loads, scan_closed
from loadwarden.streaming.watch import file_stream, run_available

START = datetime(2031, 6, 1)


def _rows(day, n, scale=1.0):
    return [(f"D{day:02d}", START + timedelta(days=day, minutes=7 * k), 1000 * day + k, scale * (50 + k % 7)) for k in range(n)]


def _write(spark, rows, path):
    spark.createDataFrame(rows, "_load_id string, _loaded_at timestamp_ntz, id long, level double").coalesce(1).write.mode("append").parquet(path)


def test_a_load_closes_once_and_late_rows_hold_it_open(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    got = []

    def run():
        stream = file_stream(spark, src, "_load_id string, _loaded_at timestamp_ntz, id long, level double", max_files=1)
        run_available(closed_loads(stream, F.col("_load_id"), "_loaded_at", "6 hours", "1 hour"),
                      lambda b, i: got.extend((r.load_id, r.row_count) for r in b.collect()), mark)

    _write(spark, _rows(1, 40) + [(None, START, 1, 1.0), ("D01", None, 1, 1.0)], src)
    _write(spark, _rows(2, 10), src)
    run()
    assert got == [("D01", 40)]
    _write(spark, _rows(2, 30)[10:], src)  # the load goes on after the restart
    _write(spark, _rows(3, 5), src)
    run()
    assert got == [("D01", 40), ("D02", 30)]
    run()
    assert got == [("D01", 40), ("D02", 30)]


def test_stream_decides_as_the_batch_scan(spark, tmp_path):
    src = str(tmp_path / "bronze")
    for day in range(1, 5):
        _write(spark, _rows(day, 120), src)
    lineage = Lineage(column_map(spark, "stg_levels", "dam.raw.levels", "id", [{"alias": "level", "source": "level", "type": "float"}]),
                      *lineage_tables(spark, [("model.d.stg_levels", "model.d.gauge")], [("model.d.stg_levels", "model", "stg_levels", None, None, None, None, None)]), "d")
    streamed, batch = (ControlPlane(spark, str(tmp_path / n)) for n in ("streamed", "batch"))
    schema = spark.read.parquet(src).schema

    def watched():
        return WatchedTable("dam.raw.levels", "id", [spark.read.schema(schema).parquet(src)])

    for c in (streamed, batch):
        bootstrap(c, [watched()], START)
    # two loads in pieces, a restart in between, and a load that stays open
    for rows in (_rows(5, 120)[:50], _rows(5, 120)[50:], _rows(6, 120, 1000.0)[:70]):
        _write(spark, rows, src)

    def run():
        stream = file_stream(spark, src, schema, max_files=1)
        scan_closed(spark, stream, F.col("_load_id"), "_loaded_at", watched(), streamed, lineage, Policy(), str(tmp_path), START + timedelta(days=9), "4 hours", "1 hour")

    run()
    state = {r.load_id: r.status for r in gate_latest(streamed.read("gate_log")).collect()}
    assert state == {**{f"D0{d}": "PASSED" for d in range(1, 6)}}
    _write(spark, _rows(6, 120, 1000.0)[70:], src)
    _write(spark, _rows(7, 3), src)
    run()
    scan(batch, [watched()], lineage, Policy(), START + timedelta(days=9), only=spark.createDataFrame(
        [("dam.raw.levels", "D05"), ("dam.raw.levels", "D06")], "table_fqn string, load_id string"))

    def outcome(c):
        return sorted((r.load_id, r.status, r.row_count, r.incident_id) for r in gate_latest(c.read("gate_log")).collect())

    assert outcome(streamed) == outcome(batch)
    assert {r[0]: r[1] for r in outcome(streamed)}["D06"] == "QUARANTINED"
