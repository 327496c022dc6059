"""The whole detection chain over many tables and loads, as one lazy plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loadwarden.operators.classify import classify
from loadwarden.operators.gate import baseline_loads, last_passed_snapshot, rolling_baseline, rolling_snapshot
from loadwarden.operators.lineage import blast_radius
from loadwarden.operators.rename import exact_containment, scored_pairs
from loadwarden.operators.routing import route
from loadwarden.operators.schema_diff import schema_diff
from loadwarden.policy import Policy
from loadwarden.session import write_through


@dataclass
class Inputs:
    """What the decision about the candidate loads rests on."""
    candidates: DataFrame            # table_fqn, load_id
    gate: DataFrame                  # latest gate rows
    snapshots: DataFrame             # schema rows of all loads concerned
    profiles: DataFrame              # column profiles of baseline and candidate loads
    counts: DataFrame | None = None  # value counts, for exact containment
    containment: DataFrame | None = None  # or pair scores from stored sketches
    key_columns: DataFrame | None = None  # table_fqn, key_column
    restated: DataFrame | None = None     # restatement evidence
    changed: DataFrame | None = None      # null rates and distinct counts of columns that came or went, where `profiles` lacks them


@dataclass
class Detection:
    diff: DataFrame
    baseline: DataFrame
    scored: DataFrame
    events: DataFrame


def structure(candidates: DataFrame, gate: DataFrame, snapshots: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(baseline loads, schema differences) of the candidates: schema rows only, no data is read.

    Candidates with a `rank` are taken in that order, each as if those of its table before it had passed; without one, none becomes the baseline
    of another. Both results are small and read by every later step, so each is written once instead of being planned in every branch.
    """
    n = policy.thresholds["semantic_baseline_loads"]
    if "rank" in candidates.columns:
        baseline, before = rolling_baseline(gate, candidates, n), rolling_snapshot(snapshots, gate, candidates)
    else:
        baseline, before = baseline_loads(gate, candidates, n), last_passed_snapshot(snapshots, gate, candidates)
    diff = schema_diff(snapshots, before)
    return write_through(baseline, "baselines"), write_through(diff, "schema-diff")


def scored_changes(x: Inputs, policy: Policy, known: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The `scored_pairs` of the candidate loads, written: matching and classification both read it."""
    baseline, diff = known
    contained = x.containment if x.containment is not None else exact_containment(diff, baseline, x.counts)
    return write_through(scored_pairs(diff, x.profiles if x.changed is None else x.changed, baseline, contained, policy.thresholds), "scored-pairs")


def detect(x: Inputs, policy: Policy, known: tuple[DataFrame, DataFrame] | None = None,
           scored: DataFrame | None = None) -> Detection:
    """Events of the candidate loads."""
    baseline, diff = known or structure(x.candidates, x.gate, x.snapshots, policy)
    scored = scored_changes(x, policy, (baseline, diff)) if scored is None else scored
    events = classify(diff, scored, x.profiles, baseline, policy.thresholds, x.key_columns, x.restated)
    return Detection(diff, baseline, scored, events)


def decide(candidates: DataFrame, events: DataFrame, column_map: DataFrame, nodes: DataFrame, edges: DataFrame,
           project: str, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(decisions, blast radius) of the candidate loads."""
    blast = blast_radius(events, column_map, nodes, edges, project, policy.blast)
    return route(candidates, events, blast, policy), blast
