"""Thresholds, severity matrix and playbooks: the routing table, as data."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Thresholds of the checks.
THRESHOLDS = {
    "rename_min_score": 0.90,
    "rename_weights": {"value_containment": 0.6, "null_rate": 0.2, "distinct_ratio": 0.2},
    "rename_min_distinct": 50,
    "semantic_min_factor": 3.0,
    "semantic_min_robust_z": 6.0,
    "semantic_baseline_loads": 7,
    "semantic_min_loads": 3,
    "categorical_psi": 0.25,
    "categorical_domain_overlap": 0.8,
    "known_factors": [
        {"factor": 84.0, "tolerance": 0.10, "label": "INR→USD (≈84 INR per USD)"},
        {"factor": 100.0, "tolerance": 0.02, "label": "major unit → minor unit (×100, e.g. rupees→paise)"},
        {"factor": 1000.0, "tolerance": 0.02, "label": "units → thousands (×1000)"},
    ],
}
# Order of classes, most severe first.
CLASS_PRECEDENCE = ["breaking", "semantic", "rename", "type_widening", "additive"]
# Severity by class and blast tier.
SEVERITY = {
    "additive": {"low": "SEV4", "medium": "SEV4", "high": "SEV4"},
    "type_widening": {"low": "SEV4", "medium": "SEV3", "high": "SEV3"},
    "rename": {"low": "SEV3", "medium": "SEV2", "high": "SEV1"},
    "breaking": {"low": "SEV2", "medium": "SEV1", "high": "SEV1"},
    "semantic": {"low": "SEV2", "medium": "SEV1", "high": "SEV1"},
}
NO_DRIFT_SEVERITY = "SEV5"
HUMAN_APPROVAL_SEVERITIES = ["SEV1", "SEV2"]
# Blast tier rules.
BLAST_RULES = {"high_any_tier1": True, "high_min_models": 4, "medium_min_exposures": 1, "medium_min_models": 2}
DEFAULT_EXPOSURE_TIER = 9
# Playbook per class (route, gate, fix action, notify action, auto merge, SLA minutes).
PLAYBOOKS = {
    "additive": ("auto_document", "PASS", "add_source_column", "none", True, 1440),
    "type_widening": ("contract_update_pr", "HOLD", "update_contract_type", "fyi_comment", True, 240),
    "rename": ("compat_alias_pr", "HOLD", "remap_source_column", "jira_and_producer_note", False, 60),
    "breaking": ("quarantine_and_remap", "QUARANTINE", "propose_breaking_remap", "jira_and_producer_note", False, 120),
    "semantic": ("quarantine_and_confirm", "QUARANTINE", "normalize_after_confirmation",
                 "jira_and_producer_confirmation", False, 60),
    "no_drift": ("pass", "PASS", "none", "none", False, 0),
}
# Gate word of a playbook and the status it leads to.
GATE_STATUS = {"PASS": "PASSED", "HOLD": "PENDING", "QUARANTINE": "QUARANTINED"}
SYSTEM_COLUMNS = ("_LOAD_ID", "_LOADED_AT")


@dataclass(frozen=True)
class Policy:
    thresholds: dict = field(default_factory=lambda: THRESHOLDS)
    precedence: list[str] = field(default_factory=lambda: CLASS_PRECEDENCE)
    severity: dict = field(default_factory=lambda: SEVERITY)
    human: list[str] = field(default_factory=lambda: HUMAN_APPROVAL_SEVERITIES)
    blast: dict = field(default_factory=lambda: BLAST_RULES)
    playbooks: dict = field(default_factory=lambda: PLAYBOOKS)

    def severity_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, t, s) for c, tiers in self.severity.items() for t, s in tiers.items()]
        return spark.createDataFrame(rows, "top_class string, tier string, severity string")

    def playbook_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, *p) for c, p in self.playbooks.items()]
        return spark.createDataFrame(rows, "top_class string, route string, gate string, fix_action string, "
                                           "notify_action string, auto_merge_when_green boolean, sla_minutes int")

    def precedence_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, i) for i, c in enumerate(self.precedence)],
                                     "drift_class string, precedence int")
