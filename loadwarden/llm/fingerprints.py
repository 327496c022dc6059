"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is its sequence of three-word k-mers, each with the number of its earlier occurrences, so that repeats count. Hashing the numbered
k-mers ranks them at random; in each of BINS equal parts of the hash range the two smallest are selected, put back into the order
in which they stand in the text, and hashed together. Moving a passage changes the order and with it the hash, so agreement follows the
edit distance, not only the set of k-mers. The fingerprint is a string of four hexadecimal digits per part, `----` where a part is empty.

The share p of parts that agree estimates the square of the Jaccard index of the k-mers (both selected ones must be shared), and the
likeness is the share of text in common that this index means, 2J / (1 + J): 1 for equal texts, near a half when half of a text was replaced.

Everything about one text happens within its row: hashes and places are packed into long integers, sorted as such, and numbered by runs. Null
texts count as empty; empty texts and texts of white space share one fingerprint; shorter texts than a k-mer are one k-mer; texts
of any length are read whole; repeated rows get equal fingerprints; an empty table gives no row; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The characters between words.
SPACES = " \t\n\x0b\f\r"
# end of fixed values

WORDS, BINS = 3, 64
_BIN_SHIFT = 58
#: Places take the low 31 bits of a packed value, hashes the rest.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1
_EMPTY = "----"


def _packed(key: Column, place: Column) -> Column:
    return key.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)


def _key(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS)


def _run_starts(ordered: str, part) -> Column:
    """Where `part` of the sorted values begins to differ from the value before."""
    values = F.col(ordered)
    return F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (part(F.get(values, i)) != part(F.get(values, i - 1))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` and the fingerprint of its non-null text column. Each step is its own column, so that no array is computed twice."""
    a, b, c, d, e = (f"__{name}_{x}" for x in "abcde")
    words, n = F.col(a), F.size(F.col(a))
    kmer = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS)))
    df = df.withColumn(a, F.split(F.btrim(F.col(text), F.lit(SPACES)), "[ \\t-\\r]+"))
    df = df.withColumn(b, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))),
                                                   lambda i: _packed(kmer(i), i.cast("long")))))
    kmers, starts = F.col(b), F.col(c)
    df = df.withColumn(c, _run_starts(b, _key))
    numbered = lambda x, occurrence: _packed(F.xxhash64(_key(x), occurrence), x.bitwiseAND(F.lit(_PLACE)))
    of_run = lambda s, j: F.transform(
        F.sequence(s, F.coalesce(F.get(starts, j + 1), F.size(kmers)) - 1), lambda i: numbered(F.get(kmers, i), i - s))
    df = df.withColumn(d, F.sort_array(F.when(F.size(starts) == F.size(kmers), F.transform(kmers, lambda x: numbered(x, F.lit(0))))
                                       .otherwise(F.flatten(F.transform(starts, of_run)))))
    ranked = F.col(d)
    bin_of = lambda x: F.shiftrightunsigned(x, _BIN_SHIFT)

    def selected(s):
        first, second = F.get(ranked, s), F.get(ranked, s + 1)
        pair = F.when(bin_of(second) != bin_of(first), F.xxhash64(_key(first))).when(
            second.bitwiseAND(F.lit(_PLACE)) < first.bitwiseAND(F.lit(_PLACE)), F.xxhash64(_key(second), _key(first))).otherwise(
            F.xxhash64(_key(first), _key(second)))
        return F.struct(bin_of(first).alias("bin"), F.substring(F.lower(F.hex(pair.bitwiseOR(F.lit(-1 << 63)))), -4, 4).alias("sig"))

    df = df.withColumn(e, F.map_from_entries(F.transform(_run_starts(d, bin_of), selected)))
    # asked twice on purpose: the optimizer would move a column used once into this function and compute it for every part
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")),
                        lambda j: F.when(F.map_contains_key(F.col(e), j), F.element_at(F.col(e), j)).otherwise(_EMPTY))
    return df.withColumn(name, F.array_join(parts, "")).drop(a, b, c, d, e)


def likeness(left: str, right: str) -> Column:
    """Estimated share of text in common (0 to 1) of two fingerprints."""
    one = lambda fp, i: F.substring(F.col(fp), i * 4 + 1, F.lit(4))
    at = F.sequence(F.lit(0), F.lit(BINS - 1))
    both = F.size(F.filter(at, lambda i: (one(left, i) == one(right, i)) & (one(left, i) != _EMPTY)))
    some = F.size(F.filter(at, lambda i: (one(left, i) != _EMPTY) | (one(right, i) != _EMPTY)))
    j = F.sqrt(both / some)
    return 2 * j / (1 + j)


def _with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (rng, doc_id, sig, text, n_chars, guest) and the window in which the next row is the next document: ids descending, rows of equal ids by
    the hash of their text, null ids last, the first after the last. The ids are cut into ranges of about equal numbers of rows; every
    range also gets, as a guest at its end, the first row of the range below."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    below = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    rows = rows.withColumns({"rng": F.coalesce(F.when(F.col("doc_id").isNotNull(), below), F.lit(-1)), "sig": F.xxhash64("text")})
    tops = rows.groupBy("rng").agg(F.max(F.struct("doc_id", F.bitwise_not("sig").alias("not_sig"))).alias("top")).select(
        "rng", F.col("top.doc_id").alias("top_id"), F.bitwise_not("top.not_sig").alias("top_sig"))
    above = Window.orderBy(F.desc("rng"))  # a row per range
    placed = tops.withColumn("to_rng", F.coalesce(F.lag("rng").over(above), F.min("rng").over(Window.partitionBy(F.lit(0)))))
    # as many rows as there are ranges, so this broadcast is bounded
    guests = (rows.join(F.broadcast(placed.drop("rng")), F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("sig") == F.col("top_sig")))
              .groupBy("to_rng", "doc_id", "sig").agg(F.first("text").alias("text")))
    every = rows.select("rng", "doc_id", "sig", "text", F.lit(False).alias("guest")).union(guests.select("to_rng", "doc_id", "sig", "text", F.lit(True)))
    return every.withColumn("n_chars", F.char_length("text").cast("long")), Window.partitionBy("rng").orderBy(
        "guest", F.desc_nulls_last("doc_id"), "sig")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, following = _with_next(docs)
    rows = with_fingerprint(rows, "text", "fingerprint").withColumns(
        {"next_text": F.lead("text").over(following), "next_fingerprint": F.lead("fingerprint").over(following)}).filter(~F.col("guest"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
