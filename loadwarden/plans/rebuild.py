"""Rebuild of the models that a release concerns: levels of the lineage graph, versioned folders, and publication by one append.

A model is written to a folder of its own version and read by nobody until its version is published. All versions of a release are published by a single file of the
`publications` table, so a reader sees all of them or none, and what was published before stays where it is when a test fails or the driver is lost.
"""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.operators.lineage import affected_models
from loadwarden.session import cut_lineage, write_through
from loadwarden.sources.control import ControlPlane

#: Models of one level that are written at the same time.
AT_ONCE = 4


@dataclass
class Model:
    """How a model is made: `build` gets the models it reads, in the order of `reads`; a staging model reads none and gets the gate log instead.
    `tests` gives failure rows (model, column_name, test, failures) from the written model."""
    reads: tuple[str, ...]
    build: Callable[..., DataFrame]
    tests: Callable[[DataFrame], list[DataFrame]] = field(default=lambda model: [])


def levels(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(model, level) of the wanted models: 0 reads none of them, and every model stands above all it reads.

    In each round the models without a parent left get their level; what is left is cut to the checkpoint folder. A cycle fails the job.
    """
    left = wanted.select("model").distinct()
    between = edges.select(F.col("src").alias("parent"), F.col("dst").alias("model")).join(left, "model", "left_semi").join(
        left.withColumnRenamed("model", "parent"), "parent", "left_semi").where("parent <> model").distinct()
    done, level = None, 0
    while not left.isEmpty():
        held = between.select("model").distinct()
        free = cut_lineage(left.join(held, "model", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise ValueError("the lineage of the models has a cycle")
        done = free if done is None else done.unionByName(free)
        left = cut_lineage(left.join(free, "model", "left_anti"))
        between = cut_lineage(between.join(free.select(F.col("model").alias("parent")), "parent", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def published(control: ControlPlane) -> DataFrame:
    """Latest published version of each model."""
    return control.read("publications").groupBy("model").agg(F.max_by(F.struct("version", "path", "row_count", "release_id"), "version").alias("_p")).select("model", "_p.*")


class Rebuild:
    """One rebuild: `build` writes new versions of the affected models, `tests` gives their failures, `publish` swaps them in."""

    def __init__(self, control: ControlPlane, models: dict[str, Model], edges: DataFrame, release_id: str, at: datetime):
        self.control, self.models, self.edges, self.release_id, self.at = control, models, edges, release_id, at
        self.version = f"{int(at.timestamp() * 1_000_000):020d}"
        self.made: dict[str, tuple[str, int, DataFrame]] = {}
        self.results: DataFrame | None = None

    def _node(self, column: str):
        return F.element_at(F.split(column, r"\."), -1).alias(column)

    def affected(self, changed: list[str], known: set[str]) -> DataFrame:
        """The changed models, what is downstream of them, and models that have never been published; only those of this project."""
        nodes = self.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        start = nodes.where(self._node("node").isin(changed))
        spark = self.control.spark
        new = spark.createDataFrame([(m,) for m in self.models if m not in known or m in changed], "model string")
        ours = spark.createDataFrame([(m,) for m in self.models], "model string")
        return affected_models(self.edges, start).union(new).distinct().join(ours, "model", "left_semi")

    def build(self, log: DataFrame, changed: list[str]) -> dict[str, DataFrame]:
        """Writes the affected models level by level; models beside them are read as published. Returns the written models."""
        spark = self.control.spark
        before = {r["model"]: r["path"] for r in published(self.control).select("model", "path").collect()}  # a row per model
        between = self.edges.select(self._node("src"), self._node("dst"))
        plan = sorted((r["level"], r["model"]) for r in levels(between, self.affected(changed, set(before))).collect())
        self.level = {m: k for k, m in plan}

        def source(name: str) -> DataFrame:
            return self.made[name][2] if name in self.made else spark.read.parquet(before[name])

        def write(name: str) -> tuple[str, tuple[str, int, DataFrame]]:
            model = self.models[name]
            path = f"{self.control.root}/models/{name}/{self.version}"
            model.build(*(map(source, model.reads) if model.reads else [log])).write.mode("overwrite").parquet(path)
            whole = spark.read.parquet(path)
            return name, (path, whole.count(), whole)

        for k in sorted(set(self.level.values())):
            with ThreadPoolExecutor(AT_ONCE) as pool:
                self.made.update(pool.map(write, [m for m in self.level if self.level[m] == k]))
        return {m: df for m, (_, _, df) in self.made.items()}

    def tests(self) -> DataFrame:
        parts = [t for m in self.made for t in self.models[m].tests(self.made[m][2])]
        schema = "model string, column_name string, test string, failures bigint"
        return write_through(reduce(DataFrame.unionByName, parts, self.control.spark.createDataFrame([], schema)), "tests")

    def finish(self, results: DataFrame, clean: bool) -> None:
        """Notes the outcome of every model, and publishes all of them when the tests are clean."""
        spark = self.control.spark
        rows = spark.createDataFrame([(self.release_id, m, self.version, path, n, self.at, self.level[m]) for m, (path, n, _) in sorted(self.made.items())],
                                     "release_id string, model string, version string, path string, row_count bigint, published_at timestamp_ntz, level int")
        if clean:
            # one file, which appears under its name at once
            self.control.append("publications", rows.drop("level").coalesce(1))
        failed = results.groupBy("model").agg(F.sum("failures").alias("failures"))
        self.control.insert_absent("release_results", rows.join(failed, "model", "left").select(
            "release_id", "model", "version", "level", "row_count", F.coalesce("failures", F.lit(0)).alias("failures"), F.lit(clean).alias("published")),
            ["release_id", "model"])
