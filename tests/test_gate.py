import random
from datetime import datetime, timedelta

import pytest

from loadwarden.operators import gate

LEGAL = {("PENDING", "PENDING"), ("PENDING", "PASSED"), ("PENDING", "QUARANTINED"), ("PASSED", "PASSED"),
         ("PASSED", "QUARANTINED"), ("QUARANTINED", "QUARANTINED")}
T0 = datetime(2026, 1, 1)


def _log(spark, rows):
    return spark.createDataFrame([(i, t, l, s, inc, by, T0 + timedelta(seconds=i), n, ok)
                                  for i, (t, l, s, inc, by, n, ok) in enumerate(rows)], gate.GATE_LOG_SCHEMA)


def test_audit_and_latest_match_a_fold(spark, monkeypatch):
    monkeypatch.setattr(gate, "SEQ_BUCKETS", 5)
    rnd = random.Random(4)
    # one load holds a third of the log
    rows = [("t", "hot" if rnd.random() < 0.33 else f"l{rnd.randrange(12)}", rnd.choice(gate.STATUSES),
             rnd.choice([None, f"INC-{i}"]), f"by{i}", i, rnd.random() < 0.3) for i in range(400)]
    log = _log(spark, rows)
    state, expected, latest = {}, {}, {}
    for i, (t, l, s, inc, by, n, ok) in enumerate(rows):
        cur = state.get(l, "PENDING")
        legal = (cur, s) in LEGAL or (cur, s) == ("QUARANTINED", "PASSED") and ok
        expected[i] = (cur, legal)
        if legal:
            state[l] = s
            old = latest.get(l)
            latest[l] = (s, inc or (old and old[1]), by, old[3] if old else n)
    got = {r["seq"]: (r["current"], r["legal"]) for r in gate.gate_audit(log).collect()}
    assert got == expected
    rows = {r["load_id"]: (r["status"], r["incident_id"], r["decided_by"], r["row_count"])
            for r in gate.gate_latest(gate.accepted(log)).collect()}
    assert rows == latest


@pytest.mark.parametrize("history,ask,approved,ok", [
    ([], "PASSED", False, True), (["PASSED"], "QUARANTINED", False, True), (["PASSED"], "PENDING", False, False),
    (["QUARANTINED"], "PASSED", False, False), (["QUARANTINED"], "PASSED", True, True), (["QUARANTINED"], "PENDING", True, False)])
def test_illegal_requests_fail(spark, history, ask, approved, ok):
    rows = [("t", "l", s, None, "x", 1, False) for s in history]
    log = _log(spark, rows)
    ask_row = spark.createDataFrame([(99, "t", "l", ask, None, "x", T0, None, approved)], gate.GATE_LOG_SCHEMA)
    if ok:
        assert gate.require_legal(log, ask_row).count() == 1
    else:
        with pytest.raises(Exception, match="illegal load-gate transition"):
            gate.require_legal(log, ask_row).collect()


def test_baseline_and_snapshot_choice(spark):
    g = spark.createDataFrame([("t", f"L{i}", "PASSED" if i < 10 else "PENDING") for i in range(12)] + [("u", "L5", "PENDING"), ("u", "L4", "PENDING")],
                              "table_fqn string, load_id string, status string")
    cand = g.where("status = 'PENDING'")
    base = gate.baseline_loads(g, cand, 7)
    assert sorted(r["base_load_id"] for r in base.where("load_id = 'L11'").collect()) == [f"L{i}" for i in range(3, 10)]
    snaps = g.selectExpr("table_fqn", "load_id as snapshot_id")
    got = {(r[0], r[1]): r[2] for r in gate.last_passed_snapshot(snaps, g, cand).collect()}
    # without any passed load: the latest earlier one, never the load itself
    assert got[("t", "L11")] == "L9" and got[("u", "L5")] == "L4" and got[("u", "L4")] is None
