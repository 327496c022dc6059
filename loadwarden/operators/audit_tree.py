"""A tree of checksums per load: tells which branch of a load changed, and then which rows and columns, reading that branch alone.

The leaves of a load are ranges of the hash of its key; a node's checksum is the sum of those below it, so a tree is made in one pass of
partial aggregates and its size depends on the number of loads, not of rows. Two trees are compared from the roots down: a node is
looked at only if its parent differs. Rows are read again only for loads and leaves that differ.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwarden.operators.quality import row_digest

#: Each node has 2^BITS children; leaves lie DEPTH levels below the root.
BITS, DEPTH = 4, 3


def _leaf(key: str, bits: int, depth: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits * depth)).cast("int")


def audit_tree(rows: DataFrame, key: str, load_col: str = "_load_id", bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """load_id, level, node, row_count, checksum; level 0 is the load itself."""
    leaves = rows.groupBy(F.col(load_col).alias("load_id"), _leaf(key, bits, depth).alias("_leaf")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(row_digest(rows.columns)).alias("_sum"))
    above = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("_leaf", bits * (depth - i)).alias("node")) for i in range(depth + 1)])
    return (leaves.select("load_id", F.inline(above), "_rows", "_sum").groupBy("load_id", "level", "node")
            .agg(F.sum("_rows").alias("row_count"), F.sum("_sum").cast("decimal(38,0)").alias("checksum")))


def differing_branches(before: DataFrame, after: DataFrame, bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """load_id, level, node, rows_before, rows_after of every node that is not the same in both trees."""
    found = []
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("load_id", "node", F.struct("row_count", "checksum").alias(name))
                 for t, name in ((before, "_b"), (after, "_a"))]
        if found:
            parents = found[-1].select("load_id", F.col("node").alias("_parent"))
            sides = [t.withColumn("_parent", F.shiftright("node", bits)).join(parents, ["load_id", "_parent"], "left_semi").drop("_parent") for t in sides]
        both = sides[0].join(sides[1], ["load_id", "node"], "full").where(~F.col("_b").eqNullSafe(F.col("_a")))
        found.append(both.select("load_id", F.lit(level).alias("level"), "node", F.coalesce("_b.row_count", F.lit(0)).alias("rows_before"),
                                 F.coalesce("_a.row_count", F.lit(0)).alias("rows_after")))
    return reduce(DataFrame.unionByName, found)


def changed_rows(before: DataFrame, after: DataFrame, branches: DataFrame, key: str, load_col: str = "_load_id", bits: int = BITS,
                 depth: int = DEPTH) -> DataFrame:
    """load_id, the key, how its rows changed (missing, new, repeated: their number differs; value) and the columns whose values differ.

    Only rows in differing leaves take part. Rows that share a key are compared as a bag; a null key is a key. Both sides have the same columns.
    """
    leaves = branches.where(F.col("level") == depth).select(F.col("load_id").alias("_l"), F.col("node").alias("_n"))
    names = sorted(c for c in before.columns if c not in (key, load_col))

    def side(rows: DataFrame) -> DataFrame:
        near = rows.join(leaves, (F.col(load_col) == F.col("_l")) & (_leaf(key, bits, depth) == F.col("_n")), "left_semi")
        return near.groupBy(F.col(load_col).alias("load_id"), F.col(f"`{key}`").alias("_key")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(row_digest([c])).alias(f"c{i}") for i, c in enumerate(names)])

    b, a = side(before).alias("b"), side(after).alias("a")
    both = b.join(a, (F.col("b.load_id") == F.col("a.load_id")) & F.col("b._key").eqNullSafe(F.col("a._key")), "full")
    moved = F.array_compact(F.array(*[F.when(F.col(f"b.c{i}") != F.col(f"a.c{i}"), F.lit(c)) for i, c in enumerate(names)]).cast("array<string>"))
    change = (F.when(F.col("a.n").isNull(), "missing").when(F.col("b.n").isNull(), "new")
              .when(F.col("a.n") != F.col("b.n"), "repeated").when(F.size(moved) > 0, "value"))
    return both.select(F.coalesce("b.load_id", "a.load_id").alias("load_id"), F.when(F.col("b.n").isNull(), F.col("a._key")).otherwise(F.col("b._key")).alias(key),
                       change.alias("change"), F.when(change == "value", moved).otherwise(F.array().cast("array<string>")).alias("columns")).where("change IS NOT NULL")
