"""Verify and release: approved loads pass the gate when the models that read them still build and test clean. An approval holds for one release."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.operators.gate import request_order, require_legal
from loadwarden.operators.incidents import incident_latest, open_incidents
from loadwarden.plans.rebuild import Model, Rebuild
from loadwarden.session import write_through
from loadwarden.sources.control import ControlPlane


APPROVAL_SCHEMA = "table_fqn string, load_id string, incident_id string, approved boolean"


@dataclass
class Approval:
    table_fqn: str
    load_id: str
    incident_id: str
    approved: bool


def approve(control: ControlPlane, incident_id: str, by: str, at: datetime, approved: bool = True) -> None:
    """Note a person's word on an incident; the next release takes it up. The last word counts."""
    control.append("approvals", control.spark.createDataFrame([(incident_id, approved, by, at)],
                                                              "incident_id string, approved boolean, approved_by string, approved_at timestamp_ntz"))


def waiting(control: ControlPlane) -> DataFrame:
    """Incidents that are not resolved and whose last word is a yes: table_fqn, load_id, incident_id, approved.

    A word counts for the incident as it stood when it was given: once the incident is opened again, as by a release that failed, words from before are used up.
    """
    log = control.read("incident_log")
    opened = log.where(F.col("status") == "OPEN").groupBy("incident_id").agg(F.max("at").alias("_opened"))
    words = (control.read("approvals").join(opened, "incident_id").where(F.col("approved_at") > F.col("_opened"))
             .groupBy("incident_id").agg(F.max_by("approved", "approved_at").alias("approved")).where("approved"))
    return open_incidents(incident_latest(log)).join(words, "incident_id").select("table_fqn", "load_id", "incident_id", "approved")


def _gate_rows(control: ControlPlane, approvals: DataFrame, status: str, at: datetime, step: int) -> DataFrame:
    when = F.lit(at).cast("timestamp_ntz")
    rows = approvals.withColumns({"seq": F.lit(request_order(at, 2 + step)), "status": F.lit(status), "decided_by": F.lit("audit"),
                                  "decided_at": when, "row_count": F.lit(None)})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in control.read("gate_log").schema.fields])


def _incident_rows(control: ControlPlane, approvals: DataFrame, status: str, at: datetime) -> DataFrame:
    known = {"seq": F.lit(int(at.timestamp() * 1_000_000) * 2), "at": F.lit(at), "incident_id": F.col("incident_id"), "status": F.lit(status)}
    fields = control.read("incident_log").schema.fields
    return approvals.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _asked(control: ControlPlane, approvals: list[Approval] | DataFrame | None) -> DataFrame:
    if isinstance(approvals, list):
        approvals = control.spark.createDataFrame([(a.table_fqn, a.load_id, a.incident_id, a.approved) for a in approvals], APPROVAL_SCHEMA)
    # read once: what is written below changes which incidents wait
    return write_through(waiting(control) if approvals is None else approvals, "approvals")


def _conclude(control: ControlPlane, approvals: DataFrame, asked: DataFrame, clean: bool, at: datetime) -> None:
    """The gate rows of a release in one write: loads are never PASSED in the log before their models are tested."""
    if clean:
        control.append("gate_log", asked)
        control.append("incident_log", _incident_rows(control, approvals, "RESOLVED", at))
    else:
        control.append("gate_log", asked.unionByName(_gate_rows(control, approvals, "QUARANTINED", at, 1)))
        control.append("incident_log", _incident_rows(control, approvals, "OPEN", at))


def release(control: ControlPlane, approvals: list[Approval] | DataFrame | None, build: Callable[[DataFrame], dict[str, DataFrame]],
            tests: Callable[[dict[str, DataFrame]], list[DataFrame]], at: datetime) -> DataFrame:
    """Release the approved loads, rebuild and test; on failure put them back and reopen their incidents.

    `approvals` are those noted in the control plane (None), a table of them or a list. `build` gets the gate log with the release in it and returns lazy models; `tests` returns failure rows. Returns
    the test results. An approval that is missing makes the release of a quarantined load fail.
    """
    approvals = _asked(control, approvals)
    log = control.read("gate_log")
    asked = write_through(require_legal(log, _gate_rows(control, approvals, "PASSED", at, 0)), "release")
    results = write_through(reduce(DataFrame.unionByName, tests(build(log.unionByName(asked)))), "tests")
    _conclude(control, approvals, asked, results.where(F.col("failures") > 0).isEmpty(), at)
    return results


def release_models(control: ControlPlane, approvals: list[Approval] | DataFrame | None, models: dict[str, Model], column_map: DataFrame, edges: DataFrame,
                   at: datetime) -> DataFrame:
    """`release` for written models: only those downstream of the released tables are made anew, each as a version of its own, and they are published together when
    their tests are clean. Otherwise the versions published before stay. Returns the outcome per model (`release_results`)."""
    approvals = _asked(control, approvals)
    log = control.read("gate_log")
    asked = write_through(require_legal(log, _gate_rows(control, approvals, "PASSED", at, 0)), "release")
    tables = approvals.select(F.upper("table_fqn").alias("_table")).distinct()
    changed = [r["model"] for r in column_map.join(tables, F.upper("table_fqn") == F.col("_table")).select("model").distinct().collect()]
    release_id = f"REL-{int(at.timestamp() * 1_000_000)}"
    rebuild = Rebuild(control, models, edges, release_id, at)
    rebuild.build(log.unionByName(asked), changed)
    results = rebuild.tests()
    clean = results.where(F.col("failures") > 0).isEmpty()
    # the models first: a driver lost in between leaves tested models published and the load still held, and the release is asked for again
    rebuild.finish(results, clean)
    if not approvals.isEmpty():
        _conclude(control, approvals, asked, clean, at)
    return control.read("release_results").where(F.col("release_id") == release_id)
