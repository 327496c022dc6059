"""Human-readable texts of decisions, as column expressions over event and decision rows."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadwarden.functions.ids import short_name

# Labels of the classes and marks of the severities.
CLASS_LABELS = {"additive": "Additive (new column)", "rename": "Rename", "type_widening": "Type widening",
                "breaking": "Breaking change", "semantic": "Semantic drift", "no_drift": "No drift"}
SEVERITY_MARKS = {"SEV1": "🔴", "SEV2": "🟠", "SEV3": "🟡", "SEV4": "🔵", "SEV5": "⚪"}


def _pick(mapping: dict[str, str], key: Column) -> Column:
    out = F.lit("")
    for k, v in mapping.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _s(x: Column) -> Column:
    return x.cast("string")


def event_reason(e) -> Column:
    """What was measured for an event; `e` maps a name to a column of the event row."""
    ev = e("evidence")
    rename = F.concat(e("column_after"), F.lit(" holds "), _s(ev["value_containment"]), F.lit(" of the values of "), e("column_before"),
                      F.lit("; nulls agree to "), _s(ev["null_similarity"]), F.lit(", distinct values to "), _s(ev["distinct_ratio"]),
                      F.lit("; total "), _s(ev["score"]))
    scale = F.concat(F.lit("median moved from "), _s(ev["baseline_median"]), F.lit(" to "), _s(ev["new_median"]), F.lit(", factor "),
                     _s(ev["ratio_baseline_over_new"]), F.lit(" at z "), _s(ev["robust_z"]), F.lit("; known change: "),
                     F.coalesce(ev["hypothesis"]["label"], F.lit("none")))
    codes = F.concat(F.lit("code shares moved by PSI "), _s(ev["psi"]), F.lit("; shared codes "), _s(ev["domain_overlap"]))
    others = F.array_join(F.transform(ev["possible_replacements"], lambda r: F.concat(r["column"], F.lit(": "), r["why_not_rename"])), " | ")
    dropped = F.concat(F.lit("no "), e("column_before"), F.lit(" in this load; "), F.coalesce(
        F.concat(F.lit("not its successor: "), others), F.lit("no column was added")))
    retyped = F.concat(e("column_before"), F.lit(" was "), e("type_before"), F.lit(", now "), e("type_after"), F.lit(": "), ev["type_relation"])
    added = F.concat(e("column_after"), F.lit(" of type "), e("type_after"), F.lit(" is new"))
    return (F.when(e("drift_class") == "rename", rename)
            .when(ev["check"] == "numeric_scale_shift", scale).when(e("drift_class") == "semantic", codes)
            .when(e("subtype") == "column_dropped", dropped)
            .when(e("type_before").isNotNull() & e("type_after").isNotNull(), retyped).otherwise(added))


#: What the headline says of the primary event, and the statement and question of the note, by class; braces name columns of the event.
SUBJECTS = {"rename": "{column_before} now {column_after}", "semantic": "values of {column_before}",
            "type_widening": "{column_before} now {type_after}", "breaking": "{column}", "additive": "{column}"}
STATEMENTS = {"rename": "{column_before} arrives as {column_after}. Will it stay so?",
              "semantic": "{column_before} holds other values than before ({cause}). Which unit or coding is it in?",
              "breaking": "{column_before} is no longer sent. What takes its place, and can earlier loads be sent again?",
              "type_widening": "{column_before} arrives as {type_after} instead of {type_before}. Tell us only if that is a mistake.",
              "additive": "{column_after} arrives for the first time. Should readers use it?"}


def _filled(template: str, e) -> Column:
    """A template as a column: text between braces is the event column of that name."""
    parts = []
    for i, part in enumerate(re.split(r"[{}]", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif part == "column":
            parts.append(F.coalesce(e("column_before"), e("column_after"), F.lit("")))
        elif part == "cause":
            parts.append(F.coalesce(e("evidence")["hypothesis"]["label"], F.lit("cause unknown")))
        else:
            parts.append(e(part))
    return F.concat(*parts)


def _by_class(templates: dict[str, str], key: Column, e) -> Column:
    return F.coalesce(*(F.when(key == k, _filled(t, e)) for k, t in templates.items()))


def headline(table: Column, severity: Column, top_class: Column, e) -> Column:
    """One line per incident; `e` maps a name to a column of its primary event."""
    subject = _by_class(SUBJECTS, top_class, e)
    return F.concat(_pick(SEVERITY_MARKS, severity), F.lit(" "), short_name(table), F.lit(" "), severity, F.lit(", "),
                    _pick(CLASS_LABELS, top_class), F.coalesce(F.concat(F.lit(": "), subject), F.lit("")))


def producer_note(top_class: Column, gate: Column, owner: Column, e) -> Column:
    """The note to the producing team; empty when there is no event."""
    note = F.concat(F.lit("For "), F.coalesce(owner, F.lit("the producing team")), F.lit(". "), _by_class(STATEMENTS, top_class, e),
                    F.lit(" The load's gate: "), gate, F.lit("."))
    return F.when(e("drift_class").isNull(), "").otherwise(note)
