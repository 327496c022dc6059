"""Bronze loads: reading and tagging them, the schema each one carries, generated loads and drifted variants."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwarden.functions.types import family_of, parse_type, spark_type_parts, spark_type_text, type_family

# The parsed form is kept beside the type text, so that comparing schemas parses nothing.
SNAPSHOT_SCHEMA = ("table_fqn string, snapshot_id string, column_name string, ordinal_position int, "
                   "data_type string, is_nullable boolean, "
                   "parsed struct<base: string, precision: int, scale: int, length: int>, family string")


def tag_load(rows: DataFrame, load_id: Column, loaded_at: Column) -> DataFrame:
    return rows.withColumns({"_load_id": load_id, "_loaded_at": loaded_at})


def read_load(spark: SparkSession, path: str) -> DataFrame:
    """One load with the schema its own files carry."""
    return spark.read.parquet(path)


def schema_rows(table: str, snapshot_id: str, schema: T.StructType) -> list[tuple]:
    return [(table, snapshot_id, f.name.upper(), i, spark_type_text(f.dataType), f.nullable,
             spark_type_parts(f.dataType), family_of(f.dataType)) for i, f in enumerate(schema.fields, 1)]


def with_parsed(snapshots: DataFrame) -> DataFrame:
    """Parsed type and family for schema rows that only carry type text."""
    rows = snapshots.withColumn("parsed", parse_type(F.col("data_type")))
    return rows.withColumn("family", type_family(F.col("parsed")))


def schema_snapshots(spark: SparkSession, schemas: dict[tuple[str, str], T.StructType]) -> DataFrame:
    """Column rows of each (table, load); only file footers are read, never data."""
    rows = [r for (table, load), schema in schemas.items() for r in schema_rows(table, load, schema)]
    return spark.createDataFrame(rows, SNAPSHOT_SCHEMA)


def catalog_schema(spark: SparkSession, table: str) -> DataFrame:
    """Column rows of a catalog table, in order."""
    return schema_snapshots(spark, {(table, "current"): spark.table(table).schema}).orderBy("ordinal_position")


def observed_loads(load_rows: DataFrame, table: str, load_col: str = "_load_id",
                   at_col: str = "_loaded_at") -> DataFrame:
    """table_fqn, load_id, row_count, loaded_at of every load present."""
    return load_rows.groupBy(F.col(load_col).alias("load_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(at_col).alias("loaded_at")
    ).select(F.lit(table).alias("table_fqn"), "load_id", "row_count", "loaded_at")


# ------------------------------------------------------------------ generated loads

def pick(values: list, seed: int, weights: list[float] | None = None) -> Column:
    """One of the values at random, evenly or by weight."""
    shares = weights or [1.0] * len(values)
    draw, out = F.rand(seed) * sum(shares), F.lit(values[-1])
    for k in reversed(range(len(values) - 1)):
        out = F.when(draw < sum(shares[:k + 1]), values[k]).otherwise(out)
    return out


def generated_loads(spark: SparkSession, columns: dict[str, Column], loads: int, rows_per_load: int, first_day: str = "2031-03-03",
                    prefix: str = "D", every_days: int = 1) -> DataFrame:
    """Loads of made-up rows for trials: `columns` are expressions over the row number `id`; load k is dated k steps after the first day and
    arrives at the end of its day. `_day` is there for expressions over the load's date."""
    day = F.date_add(F.lit(first_day).cast("date"), (F.floor((F.col("id") - 1) / rows_per_load) * every_days).cast("int"))
    rows = spark.range(1, loads * rows_per_load + 1).withColumn("_day", day)
    return tag_load(rows.select(*(c.alias(n) for n, c in columns.items()), "_day"), F.concat(F.lit(prefix), F.date_format("_day", "yyyyMMdd")),
                    F.date_add("_day", 1).cast("timestamp_ntz")).drop("_day")


# ------------------------------------------------------------------ drifted variants of a load

def with_added_column(load: DataFrame, name: str, value: Column) -> DataFrame:
    return load.withColumn(name, value)


def with_renamed_column(load: DataFrame, old: str, new: str) -> DataFrame:
    return load.withColumnRenamed(old, new)


def with_widened_column(load: DataFrame, name: str, new_type: str) -> DataFrame:
    return load.withColumn(name, F.col(name).cast(new_type))


def with_replaced_column(load: DataFrame, dropped: str, added: str, value: Column) -> DataFrame:
    return load.withColumn(added, value).drop(dropped)


def with_scaled_column(load: DataFrame, name: str, factor: float, digits: int = 2) -> DataFrame:
    """The same column in another unit, rounded half up in decimal arithmetic."""
    dt = load.schema[name].dataType
    exact = F.col(name).cast("decimal(28,6)") / F.lit(Decimal(str(factor)))
    return load.withColumn(name, F.round(exact, digits).cast(dt))


def with_swapped_codes(load: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return load.withColumn(name, F.when(F.col(name) == a, b).when(F.col(name) == b, a).otherwise(F.col(name)))


def first_by_key(load: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key, as a distributed top-n."""
    return load.orderBy(key).limit(n)

