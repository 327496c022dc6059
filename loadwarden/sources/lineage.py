"""Lineage manifests as node and edge tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("model", "exposure", "source")
MANIFEST_SCHEMA = """
    child_map map<string, array<string>>,
    nodes map<string, struct<name: string>>,
    exposures map<string, struct<name: string, label: string, type: string, owner: struct<name: string>,
        meta: struct<tier: int, audience: string>,
        config: struct<meta: struct<tier: int, audience: string>>>>,
    metadata struct<project_name: string>
"""


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every manifest under `path`, restricted to models, exposures and sources."""
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    kept = F.substring_index("id", ".", 1).isin(*KINDS)
    edges = (doc.select(F.explode("child_map").alias("src", "children"))
             .select("src", F.explode("children").alias("dst"))
             .where(F.substring_index("src", ".", 1).isin(*KINDS) & F.substring_index("dst", ".", 1).isin(*KINDS))
             .distinct())
    models = (doc.select(F.explode("nodes").alias("id", "node")).where(F.col("id").startswith("model."))
              .select("id", F.lit("model").alias("kind"), F.col("node.name").alias("name"),
                      *[F.lit(None).cast(t).alias(c) for c, t in _EXPOSURE_ONLY]))
    x = F.col("node")
    exposures = doc.select(F.explode("exposures").alias("id", "node")).select(
        "id", F.lit("exposure").alias("kind"), x["name"].alias("name"), x["label"].alias("label"),
        x["type"].alias("type"), x["owner"]["name"].alias("owner"),
        F.coalesce(x["config"]["meta"]["tier"], x["meta"]["tier"]).alias("tier"),
        F.coalesce(x["config"]["meta"]["audience"], x["meta"]["audience"]).alias("audience"))
    return models.unionByName(exposures).where(kept), edges


_EXPOSURE_ONLY = [("label", "string"), ("type", "string"), ("owner", "string"), ("tier", "int"),
                  ("audience", "string")]


def lineage_tables(spark: SparkSession, edges: list[tuple[str, str]],
                   nodes: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The same two tables from rows; a node is (id, kind, name, label, type, owner, tier, audience)."""
    return (spark.createDataFrame(nodes, "id string, kind string, name string, label string, type string, "
                                         "owner string, tier int, audience string"),
            spark.createDataFrame(edges, "src string, dst string"))
