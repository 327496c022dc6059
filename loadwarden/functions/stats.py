"""Scores and statistics as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scaling of the median absolute deviation, and floors of the tests.
MAD_SCALE = 1.4826
MAD_RELATIVE_FLOOR = 0.01
MAD_ABSOLUTE_FLOOR = 1e-9
PSI_FLOOR = 1e-4


def fingerprint(containment: Column, null_old: Column, null_new: Column, distinct_old: Column, distinct_new: Column,
                weights: dict[str, float]) -> Column:
    """struct(score, value_containment, null_similarity, distinct_ratio), each rounded to 4 digits."""
    zero = F.lit(0.0)
    null_sim = 1.0 - F.least(F.lit(1.0), F.abs(F.coalesce(null_old, zero) - F.coalesce(null_new, zero)))
    old = F.greatest(F.coalesce(distinct_old, F.lit(0)), F.lit(0)).cast("double")
    new = F.greatest(F.coalesce(distinct_new, F.lit(0)), F.lit(0)).cast("double")
    ratio = F.coalesce(F.try_divide(F.least(old, new), F.greatest(old, new)), F.lit(1.0))
    score = (weights["value_containment"] * containment + weights["null_rate"] * null_sim
             + weights["distinct_ratio"] * ratio)
    return F.struct(F.round(score, 4).alias("score"), F.round(containment, 4).alias("value_containment"),
                    F.round(null_sim, 4).alias("null_similarity"), F.round(ratio, 4).alias("distinct_ratio"))


def array_median(sorted_values: Column) -> Column:
    """Interpolating median of a short sorted array."""
    n = F.size(sorted_values)
    low = F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(sorted_values, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def robust_z(value: Column, baseline: Column) -> Column:
    """Distance from the baseline median in scaled median absolute deviations."""
    med = array_median(F.array_sort(baseline))
    mad = array_median(F.array_sort(F.transform(baseline, lambda x: F.abs(x - med))))
    spread = F.coalesce(F.nullif(mad, F.lit(0.0)), F.nullif(F.abs(med) * MAD_RELATIVE_FLOOR, F.lit(0.0)),
                        F.lit(MAD_ABSOLUTE_FLOOR))
    return F.abs(value - med) / (MAD_SCALE * spread)


def match_factor(ratio: Column, known: list[dict]) -> Column:
    """First known unit factor (list order; `down` before `up`) that `ratio` or its inverse meets."""
    inverse = F.coalesce(F.try_divide(F.lit(1.0), ratio), F.lit(0.0))
    hits = []
    for k in known:
        factor = float(k["factor"])
        for direction, r in (("down", ratio), ("up", inverse)):
            hits.append(F.when(F.abs(r - factor) / factor <= float(k["tolerance"]),
                               F.struct(F.lit(factor).alias("factor"), F.lit(k["label"]).alias("label"),
                                        F.lit(direction).alias("direction"))))
    return F.coalesce(*hits)


def psi_term(expected: Column, actual: Column) -> Column:
    """One value's share of the population stability index."""
    e = F.greatest(F.coalesce(expected, F.lit(0.0)), F.lit(PSI_FLOOR))
    a = F.greatest(F.coalesce(actual, F.lit(0.0)), F.lit(PSI_FLOOR))
    return (a - e) * F.ln(a / e)


def semantic_confidence(categorical: Column, subtype: Column, has_hypothesis: Column, matched_rows: Column,
                        ratio_cv: Column) -> Column:
    restated = (F.coalesce(matched_rows, F.lit(0)) >= 30) & (F.coalesce(ratio_cv, F.lit(1.0)) < 0.05)
    numeric = (F.lit(0.7) + F.when(has_hypothesis, 0.15).otherwise(0.0) + F.when(restated, 0.14).otherwise(0.0))
    codes = F.when(subtype == "code_meaning_change", 0.8).otherwise(0.75)
    return F.round(F.least(F.when(categorical, codes).otherwise(numeric), F.lit(0.99)), 2)


def budget_mode(spent: Column, budget: Column) -> Column:
    """normal | critical_only (80 % used) | paused (all used); no budget means normal."""
    used = F.try_divide(spent.cast("double"), budget.cast("double"))
    return F.when(used >= 1.0, "paused").when(used >= 0.8, "critical_only").otherwise("normal")


def containment_from_jaccard(j: Column, n_base: Column, n_new: Column) -> Column:
    """Share of the new values seen in the baseline, from a Jaccard estimate and two cardinalities."""
    raw = F.try_divide(j * (n_base + n_new), (1 + j) * n_new)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))
