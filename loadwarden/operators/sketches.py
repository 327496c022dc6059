"""Sketches kept per (load, column) and merged when read: HLL, theta, MinHash, and containment from them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.functions.stats import containment_from_jaccard

HASHES = 64
KEYS = ["table_fqn", "load_id", "column_name"]


def minhash_states(long: DataFrame, hashes: int = HASHES) -> DataFrame:
    """One signature per (table, load, column): the smallest of `hashes` seeded 64-bit hashes of its values.

    A minimum ignores repeats, so values need no distinct first and every map task sends one row per column.
    """
    minima = [F.min(F.xxhash64("value", F.lit(seed))).alias(f"h{seed}") for seed in range(hashes)]
    state = long.where(F.col("value").isNotNull()).groupBy(*KEYS).agg(*minima)
    return state.select(*KEYS, F.array(*[f"h{seed}" for seed in range(hashes)]).alias("minhash"))


def merge_minhash(states: DataFrame, keys: list[str], hashes: int = HASHES) -> DataFrame:
    """Union of value sets: the element-wise minimum of their signatures."""
    return states.groupBy(*keys).agg(
        F.array(*[F.min(F.element_at("minhash", i + 1)) for i in range(hashes)]).alias("minhash"))


def jaccard(left, right):
    """Share of equal signature positions."""
    equal = F.zip_with(left, right, lambda a, b: F.when(a == b, 1.0).otherwise(0.0))
    return F.aggregate(equal, F.lit(0.0), lambda acc, x: acc + x) / F.size(left)


def merge_hll(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct count of a union of loads, from stored sketches alone."""
    return profiles.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct_count"))


def minhash_containment(base: DataFrame, new: DataFrame) -> DataFrame:
    """Per pair: share of the new values already in the baseline, from signatures and cardinalities.

    `base`: pair keys + minhash + n_base, already merged over the baseline loads; `new`: the same with n_new.
    """
    keys = ["table_fqn", "load_id", "column_before", "column_after"]
    j = jaccard(F.col("b.minhash"), F.col("n.minhash"))
    return (base.alias("b").join(new.alias("n"), keys)
            .select(*keys, containment_from_jaccard(j, F.col("n_base"), F.col("n_new")).alias("containment")))


def pair_theta_containment(pairs: DataFrame, baseline_loads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Containment of candidate rename pairs from stored theta sketches; no row of any load is read again.

    pairs: table_fqn, load_id, column_before, column_after
    baseline_loads: table_fqn, load_id, base_load_id
    profiles: sketch profiles of all loads concerned
    """
    sketch = profiles.select("table_fqn", F.col("load_id").alias("_load"), F.col("column_name").alias("_col"), "theta")
    old = (pairs.join(baseline_loads, ["table_fqn", "load_id"])
           .join(sketch.withColumnsRenamed({"_load": "base_load_id", "_col": "column_before"}),
                 ["table_fqn", "base_load_id", "column_before"])
           .groupBy("table_fqn", "load_id", "column_before", "column_after")
           .agg(F.theta_union_agg("theta").alias("old_theta")))
    new = pairs.join(sketch.withColumnsRenamed({"_load": "load_id", "_col": "column_after", "theta": "new_theta"}),
                     ["table_fqn", "load_id", "column_after"])
    both = old.join(new, ["table_fqn", "load_id", "column_before", "column_after"])
    n_new = F.theta_sketch_estimate("new_theta")
    shared = F.theta_sketch_estimate(F.theta_intersection("old_theta", "new_theta"))
    return both.select("table_fqn", "load_id", "column_before", "column_after",
                       F.least(F.lit(1.0), F.coalesce(F.try_divide(shared, n_new), F.lit(0.0))).alias("containment"))
