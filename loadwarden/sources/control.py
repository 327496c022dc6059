"""Control-plane tables on Parquet: replaceable partitions for snapshots and profiles, append-only logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwarden.operators.gate import GATE_LOG_SCHEMA
from loadwarden.session import write_through
from loadwarden.sources.bronze import SNAPSHOT_SCHEMA

TABLES = {
    "schema_snapshots": (SNAPSHOT_SCHEMA, ["table_fqn", "snapshot_id"]),
    "column_profiles": ("table_fqn string, load_id string, column_name string, data_type string, row_count bigint, "
                        "null_rate double, distinct_count bigint, num_mean double, num_median double, num_p05 double, "
                        "num_p95 double, num_min double, num_max double, top_k map<string,double>, hll binary, theta binary",
                        ["table_fqn", "load_id"]),
    "gate_log": (GATE_LOG_SCHEMA, []),
    "drift_events": ("event_id string, incident_id string, table_fqn string, load_id string, drift_class string, "
                     "subtype string, column_before string, column_after string, type_before string, "
                     "type_after string, confidence double, evidence string", []),
    "incident_log": ("seq bigint, at timestamp_ntz, incident_id string, table_fqn string, load_id string, "
                     "top_class string, severity string, route string, blast_radius string, decision string, "
                     "status string", []),
    "comparisons": ("table_fqn string, load_id string, base_load_id string, base_rank int", []),
    "approvals": ("incident_id string, approved boolean, approved_by string, approved_at timestamp_ntz", []),
    "publications": ("release_id string, model string, version string, path string, row_count bigint, published_at timestamp_ntz", []),
    "release_results": ("release_id string, model string, version string, level int, row_count bigint, failures bigint, published boolean", []),
    "decision_trace": ("surface string, run_id string, incident_id string, step int, decision string, choice string, "
                       "reasoning string, alternatives array<string>, confidence string", ["surface"]),
}
# Tables a reset empties.
RESET_TABLES = ("schema_snapshots", "column_profiles", "gate_log", "drift_events", "incident_log", "comparisons", "approvals", "decision_trace")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key that `stored` does not hold."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


class ControlPlane:
    """Paths and write modes of the control tables below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        schema, _ = TABLES[table]
        empty = self.spark.createDataFrame([], schema)
        if not exists(self.spark, self.path(table)):
            return empty
        return self.spark.read.schema(empty.schema).parquet(self.path(table)).select(*empty.columns)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Idempotent write: the partitions named by `rows` are replaced, all others stay. Columns that `rows` lacks are null."""
        schema, parts = TABLES[table]
        typed = self.spark.createDataFrame([], schema)
        (rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in typed.schema.fields])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
         .parquet(self.path(table)))

    def append(self, table: str, rows: DataFrame) -> None:
        schema, parts = TABLES[table]
        typed = self.spark.createDataFrame([], schema)
        writer = rows.select(*[F.col(f.name).cast(f.dataType) for f in typed.schema.fields]).write.mode("append")
        (writer.partitionBy(*parts) if parts else writer).parquet(self.path(table))

    def insert_absent(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Append the rows whose key the table does not hold yet."""
        # what is read here is also written to, so the new rows are fixed first
        self.append(table, write_through(absent(rows, self.read(table), keys), table))

    def reset(self) -> None:
        for table in RESET_TABLES:
            empty = self.spark.createDataFrame([], TABLES[table][0])
            empty.write.mode("overwrite").parquet(self.path(table))

    # -------------------------------------------------------------- reads
    def snapshot(self, table: str, snapshot_id: str) -> DataFrame:
        return (self.read("schema_snapshots")
                .where((F.col("table_fqn") == table) & (F.col("snapshot_id") == snapshot_id))
                .orderBy("ordinal_position"))

    def profiles(self, loads: DataFrame) -> DataFrame:
        """Profiles of the given (table_fqn, load_id) rows."""
        return self.read("column_profiles").join(loads.select("table_fqn", "load_id").distinct(),
                                                 ["table_fqn", "load_id"], "left_semi")

    def events_of(self, incident_id: str) -> DataFrame:
        return self.read("drift_events").where(F.col("incident_id") == incident_id).orderBy("event_id")


def preserve_evidence(load_rows: DataFrame, table: str, incident_id: str, folder: str, before=None, part: int = 0) -> str:
    """Copy rows next to the control tables, those loaded up to `before` when it is given; bronze itself is never
    written. A copy that exists is kept. Returns the folder of the incident's copy."""
    path = f"{folder.rstrip('/')}/{table.split('.')[-1].upper()}_PRE_{incident_id.replace('-', '_')}"
    rows = load_rows if before is None else load_rows.where(F.col("_loaded_at") <= F.lit(before))
    # a folder without the success marker is what a killed write has left
    if not exists(load_rows.sparkSession, f"{path}/part={part}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(f"{path}/part={part}")
    return path
