"""SimHash near-duplicates over an inverted index of positional bytes with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in at most three bytes, so at
least five of the eight positional bytes are shared: the guaranteed minimum. A list per single byte would hold 1 of 256 fingerprints, so
lists are kept per group of four positions: the fourteen groups below are chosen so that any five positions contain one of them
(the complements of three positions in the extended Hamming code). Within a list the shared positional bytes of a pair are tallied, pairs
with at least five are kept, and their bits are compared. Only links that join two so far separate parts of a list leave it, never all pairs.

Equal fingerprints are one entry of the index, so groups of copies of any size cost one row. A list of more than LIST_ROWS different
fingerprints is not gathered: its entries meet through the fingerprints at one or two flipped bits, which finds every link and
lets no group exceed 2,081 rows.

Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other. Texts are read whole. Repeated rows
get equal results. Null ids never name a component; rows of a group without any id fall into one group per fingerprint. Other columns are not read by `components_of` and kept by `keep_one`.
"""
from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.llm.common import fresh, texts_of
from loadwarden.llm.components import components
from loadwarden.session import write_through

SHINGLE, BITS, BYTES = 3, 3, 8
SHARED = BYTES - BITS
#: Groups of four positions whose numbers cancel under exclusive or.
GROUPS = [g for g in combinations(range(BYTES), 4) if g[0] ^ g[1] ^ g[2] ^ g[3] == 0]
LIST_ROWS = 4_096
_BLOCK = 1 << 15


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[SHINGLE:] or starts[-1:]
    counts, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, _BLOCK):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig (hash of the text), fp (the fingerprint as a signed long) per row. No shuffle."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in texts_of(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "sig", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, sig long, fp long")


def _joins(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of one list that span its linked parts: each fingerprint is compared once with those not yet reached."""
    links, rest = [], prints
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            hit = _linked(rest, at)
            if hit.any():
                new = rest[hit]
                links += [(int(at.view(np.int64)), int(x)) for x in new.view(np.int64)]
                reached.extend(new)
                rest = rest[~hit]
    return links


def _linked(some: np.ndarray, other) -> np.ndarray:
    """Which pairs share at least the guaranteed number of positional bytes and, verified, differ in few enough bits."""
    differ = some ^ other
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= SHARED
    return shared & (np.bitwise_count(differ) <= BITS)


def _links_of_lists(lists: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            sizes = np.diff(offsets)
            first = offsets[:-1][sizes == 2]
            a, b = values[first], values[first + 1]
            hit = _linked(a, b)
            links = list(zip(a[hit].view(np.int64).tolist(), b[hit].view(np.int64).tolist()))
            for i in np.flatnonzero(sizes > 2):
                links += _joins(values[offsets[i]:offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _links_of_long_lists(prints: DataFrame) -> DataFrame:
    """Links among the given different fingerprints without gathering them: two within three bits meet at a fingerprint that one reaches by
    at most one flip and the other by at most two; whatever meets there with a one-flip member belongs together."""
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    signed = np.array(flips, dtype=np.uint64).view(np.int64).tolist()
    reach = prints.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("met"), "fp", (F.bit_count("flip") <= 1).alias("near"))
    meets = reach.groupBy("met").agg(F.min("fp").alias("low"), F.max("near").alias("near"), F.count("*").alias("n")).filter("near and n > 1")
    return reach.join(meets.select("met", "low"), "met").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): links that connect every two of the different fingerprints `fp` that a chain of links connects."""
    masks = [sum(0xFF << (8 * p) for p in g) for g in GROUPS]
    signed = np.array(masks, dtype=np.uint64).view(np.int64).tolist()
    keys = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)))
    index = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.g", "key.part")
    sizes = index.groupBy("g", "part").agg(F.count("*").alias("n")).filter("n > 1")
    listed = write_through(index.join(sizes, ["g", "part"]), "lists")
    short = listed.filter(F.col("n") <= list_rows).groupBy("g", "part").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = _links_of_lists(short)
    if not listed.filter(F.col("n") > list_rows).isEmpty():
        found = found.union(_links_of_long_lists(listed.filter(F.col("n") > list_rows).select("fp").distinct()))
    return found.distinct()


def components_of(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """fp, component_id for every different fingerprint of a written table (doc_id, fp)."""
    firsts = write_through(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), list_rows)).withColumnRenamed("node", "fp")
    linked = roots.join(firsts, "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id per row of `docs`."""
    prints = write_through(fingerprints(docs).drop("sig"), "prints")
    return prints.join(components_of(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` per component, all columns: the smallest id (a row without id only where its group has none), one of equal rows."""
    prints = write_through(fingerprints(docs), "prints")
    grouped = prints.join(components_of(prints), "fp").withColumn(
        "grp", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")))
    kept = grouped.groupBy("grp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "sig")).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.sig").alias("kept_sig"))
    id_name, sig_name, n_name = (fresh(docs, n) for n in ("kept_id", "sig", "n"))
    kept = kept.distinct().toDF(id_name, sig_name + "_kept")
    here = docs.withColumn(sig_name, F.xxhash64("text"))
    joined = here.join(kept, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(sig_name) == F.col(sig_name + "_kept")), "left_semi")
    one = Window.partitionBy("doc_id", sig_name).orderBy(sig_name)
    return joined.withColumn(n_name, F.row_number().over(one)).filter(F.col(n_name) == 1).select(*(f"`{c}`" for c in docs.columns))
