"""Reading tables, text batches and bounded training samples."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch: bounds the memory of a Python worker whatever the partition size.
BATCH_ROWS = 512
#: Bytes of text that a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Groups over which a class is drawn first.
DRAW_SALT = 64


def small_batches(spark: SparkSession) -> None:
    """Lets a Python worker see BATCH_ROWS rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, the session's settings left as they are; tasks cut their batches with `in_pieces`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_pieces(batches: Iterator[pa.RecordBatch], text_at: int = 1, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Non-empty slices of the batches whose texts hold at most `max_bytes` together, or a single row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], schema: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One output row per document: its id and the columns that `make()(texts)` returns. No shuffle; other columns are not read."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    types = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in in_pieces(batches):
            found = work(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n], type=types[t]) for n, t in fields)],
                                             names=[id_col, *(n for n, _ in fields)])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {schema}")


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text `make()(texts)` keeps. No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(work(texts_of(batch.column(at))), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_sample(docs: DataFrame, labelled: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most `per_class` labelled documents of each class, in a fixed order. `labelled` has doc_id and the label. The smallest
    hashes per class are drawn among the ids of documents with a text of at most `max_chars` code points (longer ones are left out before the
    draw, so a class falls short only where it has too few others), and only the drawn ids, a bounded table, are broadcast to fetch their texts."""
    def smallest(df: DataFrame, *groups: str) -> DataFrame:
        by = Window.partitionBy("drawn_label", *groups).orderBy("draw", "doc_id")
        return df.withColumn("draw_rank", F.row_number().over(by)).filter(F.col("draw_rank") <= per_class)

    usable = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    hashed = (labelled.groupBy("doc_id").agg(F.max(label).alias("drawn_label")).join(usable.select("doc_id"), "doc_id", "left_semi")
              .withColumn("draw", F.xxhash64("doc_id")))
    # first per class and salt, so that what many tasks have drawn does not meet in one
    salted = smallest(hashed.withColumn("salt", F.pmod("draw", F.lit(DRAW_SALT))), "salt")
    drawn = smallest(salted).select("doc_id", "drawn_label", "draw")
    fetched = (usable.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"),
                                                                        F.min("drawn_label").alias("drawn_label"), F.min("draw").alias("draw")))
    rows = sorted(fetched.collect(), key=lambda r: (r["draw"], str(r["doc_id"])))
    return [(r["text"], r["drawn_label"]) for r in rows]


def fold(id_col: str, parts: int):
    """The fold of a document: crc32 of its id as text, modulo `parts`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name
