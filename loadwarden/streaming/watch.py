"""Streams: watching a folder for new loads, keeping the latest row per key, profiling windows of events."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadwarden.operators.staging import latest_per_key


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived and stop; the checkpoint remembers what was seen."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()
    return query


def latest_rows(spark: SparkSession, root: str, schema, key: str, order: list[str]) -> DataFrame:
    """Latest row per key over the change log below `root`."""
    return latest_per_key(spark.read.schema(schema).parquet(f"{root}/log/*"), key, tuple(order))


def latest_versions(spark: SparkSession, stream: DataFrame, key: str, order: list[str], root: str) -> DataFrame:
    """Latest row per key of a stream, late and restated rows included (a plain duplicate drop would keep the first).

    Each micro-batch writes its own latest rows to a folder named after its id: the cost of a batch is that of the
    batch, not of all keys seen so far, and a replayed batch rewrites its own folder, so nothing counts twice.
    """
    schema = stream.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, key, tuple(order)).write.mode("overwrite").parquet(f"{root}/log/{batch_id:010d}")

    run_available(stream, keep, f"{root}/checkpoint")
    return latest_rows(spark, root, schema, key, order)


def compact(spark: SparkSession, root: str, schema, key: str, order: list[str], target: str) -> DataFrame:
    """The change log reduced to one row per key, written to another folder."""
    latest_rows(spark, root, schema, key, order).write.mode("overwrite").parquet(f"{target}/log/0000000000")
    return latest_rows(spark, target, schema, key, order)


def arrived_loads(spark: SparkSession, stream: DataFrame, load: Column, at: str, root: str) -> DataFrame:
    """load_id, row_count, last_at of the loads a stream has brought so far.

    A load may be spread over many micro-batches. Each batch writes its own partial counts to a folder named after its id, so a replayed
    batch rewrites its folder and nothing counts twice; the parts are summed when read.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(load.alias("load_id")).agg(F.count(F.lit(1)).alias("rows"), F.max(at).alias("last_at"))
         .write.mode("overwrite").parquet(f"{root}/arrived/{batch_id:010d}"))

    run_available(stream, keep, f"{root}/checkpoint")
    kind = stream.schema[at].dataType.simpleString()
    parts = spark.read.schema(f"load_id string, rows bigint, last_at {kind}").parquet(f"{root}/arrived/*")
    return parts.groupBy("load_id").agg(F.sum("rows").alias("row_count"), F.max("last_at").alias("last_at"))


def window_counts(events: DataFrame, time: str, category: str, value: str, width: str, delay: str) -> DataFrame:
    """Category counts and value sums per closed window; one window is one load of the stream.

    State is one small row per (window, category), dropped once the watermark has passed.
    """
    return (events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
            .groupBy(F.window("_t", width).alias("w"), F.col(category).alias("category"))
            .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.sum(value).alias("sum_value"),
                 F.min(value).alias("min_value"), F.max(value).alias("max_value"))
            .select(F.concat(F.lit("E"), F.date_format(F.col("w.start"), "yyyyMMddHHmm")).alias("load_id"),
                    "category", "n", "n_value", "sum_value", "min_value", "max_value"))


def write_windows(windows: DataFrame, root: str) -> str:
    """Run a windowed stream to its end into Parquet; returns the path."""
    path = f"{root}/windows"
    query = (windows.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return path
