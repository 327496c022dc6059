"""Column profiles of whole loads: an exact form from value counts, and a one-pass mergeable sketch form."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwarden.functions.types import canonical_text, family_of, spark_type_text
from loadwarden.operators.quantiles import ACCURACY, bracket_points, brackets, exact_quantiles, quantiles_within, with_quantiles
from loadwarden.policy import SYSTEM_COLUMNS
from loadwarden.session import write_through

KEYS = ["table_fqn", "load_id", "column_name"]
TOP_K = 20
TOP_K_TRACKED = 1000
QUANTILES = {"num_p05": 0.05, "num_median": 0.5, "num_p95": 0.95}
# Sketch merges of one load are first spread over this many groups.
MERGE_SALT = 64
PROFILE_COLUMNS = ["table_fqn", "load_id", "column_name", "data_type", "row_count", "null_rate", "distinct_count",
                   "num_mean", "num_median", "num_p05", "num_p95", "num_min", "num_max", "top_k"]


def profiled_fields(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if f.name.upper() not in SYSTEM_COLUMNS]


def _texts(load_rows: DataFrame, load_col: str, fields: list[T.StructField]) -> DataFrame:
    """load_id, column_name, value text: one row per (row, column)."""
    wide = load_rows.select(F.col(load_col).alias("load_id"), *[
        canonical_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name.upper()) for f in fields])
    return wide.unpivot(["load_id"], [F.col(f"`{f.name.upper()}`") for f in fields], "column_name", "value")


def _described(texts: DataFrame, table: str, fields: list[T.StructField], *more: str) -> DataFrame:
    """The rows with their table, and the type and family that the schema gives their column."""
    def per_column(text) -> Column:
        cases = " ".join(f"WHEN '{f.name.upper()}' THEN '{text(f.dataType)}'" for f in fields)
        return F.expr(f"CASE column_name {cases} END")

    return texts.select(F.lit(table).alias("table_fqn"), "load_id", "column_name",
                        per_column(spark_type_text).alias("data_type"), per_column(family_of).alias("family"), "value", *more)


def _named(load_rows: DataFrame, columns: set[str] | frozenset[str] | None) -> list[T.StructField]:
    return [f for f in profiled_fields(load_rows.schema) if columns is None or f.name.upper() in columns]


def long_values(load_rows: DataFrame, table: str, load_col: str = "_load_id",
                columns: set[str] | None = None) -> DataFrame:
    """One row per (row, column): table_fqn, load_id, column_name, data_type, family, value text.

    `columns` (upper case) restricts what is read; the rest is pruned from the scan.
    """
    fields = _named(load_rows, columns)
    return _described(_texts(load_rows, load_col, fields), table, fields)


def _with_number(counts: DataFrame) -> DataFrame:
    return counts.withColumn("num", F.when(F.col("family") == "numeric", F.col("value").cast("double")))


def load_counts(load_rows: DataFrame, table: str, load_col: str = "_load_id", columns: set[str] | None = None) -> DataFrame:
    """`value_counts` of the `long_values` of rows with one schema: table, type and family are put beside the counts, not into the key of every row."""
    fields = _named(load_rows, columns)
    counted = _texts(load_rows, load_col, fields).groupBy("load_id", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return _with_number(_described(counted, table, fields, "n"))


def value_counts(long: DataFrame) -> DataFrame:
    """Rows per distinct value. Copies of a hot value collapse before the shuffle, and the key holds the
    value itself, so no group grows with its load."""
    return _with_number(long.groupBy("table_fqn", "load_id", "column_name", "data_type", "family", "value")
                        .agg(F.count(F.lit(1)).alias("n")))


def top_values(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k values of text and boolean columns with their share of the top-k rows."""
    listed = counts.where(F.col("family").isin("text", "boolean") & F.col("value").isNotNull())
    order = Window.partitionBy(*KEYS).orderBy(F.desc("n"), "value")
    top = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    total = F.sum("n").over(Window.partitionBy(*KEYS))
    return top.select(*KEYS, "value", "n", "rank", (F.col("n") / total).alias("share"))


def listed_values(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """`top_values` as one map of value and share per column."""
    return top_values(counts, k).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("top_k"))


def exact_profile(long: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Profile with exact distinct counts, quantiles and top-k."""
    counts = value_counts(long) if counts is None else counts
    base = counts.groupBy(*KEYS, "data_type").agg(
        F.sum("n").alias("row_count"),
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_rate"),
        F.count("value").alias("distinct_count"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("num_mean"),
        F.min("num").alias("num_min"), F.max("num").alias("num_max"))
    numeric_rows = long.where(F.col("family") == "numeric").withColumn("num", F.col("value").cast("double"))
    quant = quantiles_within(counts, brackets(numeric_rows, KEYS, "num", QUANTILES), KEYS, "num", QUANTILES, "n")
    return with_quantiles(with_quantiles(base, quant, KEYS), listed_values(counts), KEYS).select(*PROFILE_COLUMNS)


#: Types whose distinct values are counted as they are: each value has one canonical text, so counting texts would give the same number.
_COUNTED_AS_THEY_ARE = (T.IntegralType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)


def _sql_name(f: T.StructField) -> str:
    return "`" + f.name.replace("`", "``") + "`"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def changed_profiles(counts: DataFrame) -> DataFrame:
    """Null rate and distinct count of `exact_profile`, for the columns that `counts` (`value_counts`) holds."""
    return counts.groupBy(*KEYS).agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_rate"),
        F.count("value").alias("distinct_count"))


def _by_schema(loads: list[tuple[DataFrame, str, frozenset[str]]]) -> list[tuple[DataFrame, str, frozenset[str]]]:
    """Loads of one schema of which the same columns are wanted become one input."""
    alike = {}
    for rows, table, names in loads:
        alike.setdefault((tuple(rows.dtypes), table, names), []).append(rows)
    return [(reduce(DataFrame.unionByName, rows), table, names) for (_, table, names), rows in alike.items() if names]


def column_medians(loads: list[tuple[DataFrame, str, frozenset[str]]], load_col: str = "_load_id") -> DataFrame:
    """The medians of `exact_profile` for (rows, table, numeric columns in upper case) triples; no other column is read.

    One aggregate brackets them; its result, one row per load and column, is written, so that it meets the rows as a broadcast.
    """
    loads, probs = _by_schema(loads), {"num_median": QUANTILES["num_median"]}
    points = ", ".join(f"{p!r}D" for p in bracket_points(probs))
    bounds, numbers = [], []
    for rows, table, names in loads:
        fields = _named(rows, names)
        wide = rows.groupBy(F.col(load_col).alias("load_id")).agg(*[F.expr(
            f"percentile_approx(CAST({_sql_name(f)} AS double), array({points}), {ACCURACY})").alias(f.name.upper()) for f in fields])
        bounds.append(wide.unpivot(["load_id"], [F.col(f"`{f.name.upper()}`") for f in fields], "column_name", "_brackets")
                      .select(F.lit(table).alias("table_fqn"), "load_id", "column_name", "_brackets"))
        numbers.append(_numbers(rows, table, load_col, names))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    known = write_through(union(bounds), "median-brackets").where(F.col("_brackets").isNotNull())
    return quantiles_within(union(numbers), known, KEYS, "num", probs)


def top_lists(loads: list[tuple[DataFrame, str]], load_col: str = "_load_id") -> DataFrame:
    """The top values of `exact_profile`, for all text and boolean columns of (rows, table) pairs."""
    coded = [(rows, table, frozenset(f.name.upper() for f in profiled_fields(rows.schema) if family_of(f.dataType) in ("text", "boolean")))
             for rows, table in loads]
    counts = reduce(DataFrame.unionByName, [load_counts(rows, table, load_col, names) for rows, table, names in _by_schema(coded)])
    return listed_values(counts)


def _one_pass(load_rows: DataFrame, table: str, load_col: str) -> DataFrame:
    """What one aggregate over the typed rows of each load gives: counts, sums, extremes and the brackets of the quantiles. One row per load and column."""
    fields = profiled_fields(load_rows.schema)
    points = ", ".join(f"{p!r}D" for p in bracket_points(QUANTILES))
    states, rows = ["count(1) AS row_count"], []
    for i, f in enumerate(fields):
        col, numeric = _sql_name(f), family_of(f.dataType) == "numeric"
        states.append(f"count({col}) AS _n{i}")
        numbers = ["CAST(NULL AS double)"] * 3 + ["CAST(NULL AS array<double>)"]
        if numeric:
            num, numbers = f"CAST({col} AS double)", [f"{n}{i}" for n in ("_sum", "_min", "_max", "_brackets")]
            made = [f"sum({num})", f"min({num})", f"max({num})", f"percentile_approx({num}, array({points}), {ACCURACY})"]
            states += [f"{e} AS {n}" for e, n in zip(made, numbers)]
        named = zip(("_n", "_sum", "num_min", "num_max", "_brackets"), (f"_n{i}", *numbers))
        rows.append(f"named_struct('column_name', {_sql_text(f.name.upper())}, 'data_type', '{spark_type_text(f.dataType)}', "
                    + ", ".join(f"'{n}', {e}" for n, e in named) + ")")
    # as SQL text: one call a column, where nested column objects take seconds to build for many schemas
    whole = load_rows.groupBy(F.col(load_col).alias("load_id")).agg(*map(F.expr, states))
    return whole.select(F.lit(table).alias("table_fqn"), "load_id", "row_count", F.expr(f"inline(array({', '.join(rows)}))"))


def _distinct_counts(load_rows: DataFrame, table: str, load_col: str) -> DataFrame:
    """Exact distinct values of every column of each load. The shuffle key holds the typed value, so no group grows with its load."""
    fields = profiled_fields(load_rows.schema)
    plain = lambda f: F.col(f"`{f.name}`")
    value = lambda f: plain(f) if isinstance(f.dataType, _COUNTED_AS_THEY_ARE) else canonical_text(plain(f), f.dataType)
    whole = load_rows.groupBy(F.col(load_col).alias("load_id")).agg(*[F.count_distinct(value(f)).alias(f"_d{i}") for i, f in enumerate(fields)])
    rows = [f"named_struct('column_name', {_sql_text(f.name.upper())}, 'distinct_count', _d{i})" for i, f in enumerate(fields)]
    return whole.select(F.lit(table).alias("table_fqn"), "load_id", F.expr(f"inline(array({', '.join(rows)}))"))


def _numbers(load_rows: DataFrame, table: str, load_col: str, columns: frozenset[str] | None = None) -> DataFrame:
    """One row per (row, numeric column), the value as a double."""
    fields = [f for f in _named(load_rows, columns) if family_of(f.dataType) == "numeric"]
    wide = load_rows.select(F.col(load_col).alias("load_id"), *[F.col(f"`{f.name}`").cast("double").alias(f.name.upper()) for f in fields])
    return wide.unpivot(["load_id"], [F.col(f"`{f.name.upper()}`") for f in fields], "column_name", "num").select(F.lit(table).alias("table_fqn"), "load_id", "column_name", "num")


def exact_profiles(loads: list[tuple[DataFrame, str]], load_col: str = "_load_id") -> DataFrame:
    """The profile of `exact_profile` for (rows, table) pairs, from typed columns: no value becomes text but those of text and boolean columns.

    Loads may carry different schemas, one pair per schema. The first pass is small and written, so that the brackets meet the rows as a broadcast.
    """
    of = lambda make: reduce(DataFrame.unionByName, [make(rows, table, load_col) for rows, table in loads])
    having = lambda families: [(rows, table) for rows, table in loads if any(
        family_of(f.dataType) in families for f in profiled_fields(rows.schema))]
    first = write_through(of(_one_pass), "plain-profiles")
    profile = with_quantiles(first, of(_distinct_counts), KEYS)
    numeric, coded = having({"numeric"}), having({"text", "boolean"})
    if numeric:
        numbers = reduce(DataFrame.unionByName, [_numbers(rows, table, load_col) for rows, table in numeric])
        bounds = first.where(F.col("_brackets").isNotNull()).select(*KEYS, "_brackets")
        profile = with_quantiles(profile, quantiles_within(numbers, bounds, KEYS, "num", QUANTILES), KEYS)
    else:
        profile = profile.withColumns({n: F.lit(None).cast("double") for n in QUANTILES})
    if coded:
        counts = reduce(DataFrame.unionByName, [load_counts(rows, table, load_col, {
            f.name.upper() for f in profiled_fields(rows.schema) if family_of(f.dataType) in ("text", "boolean")}) for rows, table in coded])
        profile = with_quantiles(profile, listed_values(counts), KEYS)
    else:
        profile = profile.withColumn("top_k", F.lit(None).cast("map<string,double>"))
    return profile.withColumns({
        "null_rate": (F.col("row_count") - F.col("_n")) / F.col("row_count"), "num_mean": F.try_divide(F.col("_sum"), F.col("_n"))}).select(*PROFILE_COLUMNS)


def _states(f: T.StructField) -> list[Column]:
    col = F.col(f"`{f.name}`")
    text = canonical_text(col, f.dataType)
    n = f.name.upper()
    out = [F.count(col).alias(f"{n}__n"), F.hll_sketch_agg(text).alias(f"{n}__hll"),
           F.theta_sketch_agg(text).alias(f"{n}__theta")]
    family = family_of(f.dataType)
    if family == "numeric":
        num = col.cast("double")
        out += [F.sum(num).alias(f"{n}__sum"), F.min(num).alias(f"{n}__min"), F.max(num).alias(f"{n}__max"),
                F.kll_sketch_agg_double(num).alias(f"{n}__kll")]
    if family in ("text", "boolean"):
        out.append(F.expr(f"approx_top_k_accumulate(cast(`{f.name}` as string), {TOP_K_TRACKED}) "
                          f"FILTER (WHERE `{f.name}` IS NOT NULL)").alias(f"{n}__top"))
    return out


def _merged(f: T.StructField) -> list[Column]:
    n = f.name.upper()
    out = [F.sum(f"{n}__n").alias(f"{n}__n"), F.hll_union_agg(f"{n}__hll").alias(f"{n}__hll"),
           F.theta_union_agg(f"{n}__theta").alias(f"{n}__theta")]
    family = family_of(f.dataType)
    if family == "numeric":
        out += [F.sum(f"{n}__sum").alias(f"{n}__sum"), F.min(f"{n}__min").alias(f"{n}__min"),
                F.max(f"{n}__max").alias(f"{n}__max"), F.kll_merge_agg_double(f"{n}__kll").alias(f"{n}__kll")]
    if family in ("text", "boolean"):
        out.append(F.expr(f"approx_top_k_combine(`{n}__top`, {TOP_K_TRACKED})").alias(f"{n}__top"))
    return out


def _profile_struct(f: T.StructField) -> Column:
    n, family = f.name.upper(), family_of(f.dataType)
    null_double = F.lit(None).cast("double")
    kll = (lambda p: F.when(F.col(f"{n}__n") > 0, F.kll_sketch_get_quantile_double(f"{n}__kll", F.lit(p)))
           if family == "numeric" else null_double)
    if family in ("text", "boolean"):
        items = F.expr(f"approx_top_k_estimate(`{n}__top`, {TOP_K})")
        total = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
        shares = F.map_from_entries(F.transform(items, lambda x: F.struct(x["item"], x["count"] / total)))
        top = F.when(F.size(items) > 0, shares)
    else:
        top = F.lit(None).cast("map<string,double>")
    numeric = family == "numeric"
    return F.struct(
        F.lit(n).alias("column_name"), F.lit(spark_type_text(f.dataType)).alias("data_type"),
        F.col("row_count"), (1 - F.col(f"{n}__n") / F.col("row_count")).alias("null_rate"),
        F.hll_sketch_estimate(f"{n}__hll").alias("distinct_count"),
        (F.try_divide(F.col(f"{n}__sum"), F.col(f"{n}__n")) if numeric else null_double).alias("num_mean"),
        kll(0.5).alias("num_median"), kll(0.05).alias("num_p05"), kll(0.95).alias("num_p95"),
        (F.col(f"{n}__min") if numeric else null_double).alias("num_min"),
        (F.col(f"{n}__max") if numeric else null_double).alias("num_max"),
        top.alias("top_k"), F.col(f"{n}__hll").alias("hll"), F.col(f"{n}__theta").alias("theta"))


def sketch_profile(load_rows: DataFrame, table: str, load_col: str = "_load_id") -> DataFrame:
    """Profile plus stored sketches, from one aggregate over the load and no shuffle of its rows.

    Only sketch states move. The states of one load are merged in two steps over `MERGE_SALT` groups, so
    that a load read by very many tasks does not end in a single merge.
    """
    fields = profiled_fields(load_rows.schema)
    salted = load_rows.withColumn("_salt", F.spark_partition_id() % MERGE_SALT)
    first = salted.groupBy(F.col(load_col).alias("load_id"), "_salt").agg(
        F.count(F.lit(1)).alias("row_count"), *[c for f in fields for c in _states(f)])
    whole = first.groupBy("load_id").agg(F.sum("row_count").alias("row_count"),
                                         *[c for f in fields for c in _merged(f)])
    rows = whole.select("load_id", F.inline(F.array(*[_profile_struct(f) for f in fields])))
    return rows.select(F.lit(table).alias("table_fqn"), *[c for c in PROFILE_COLUMNS if c != "table_fqn"],
                       "hll", "theta")


def load_summary(load_rows: DataFrame, value: str, load_col: str = "_load_id") -> DataFrame:
    """Rows and rounded median of one measure, per load."""
    rows = load_rows.select(F.col(load_col).alias("load_id"), F.col(value).cast("double").alias("v"))
    found = exact_quantiles(rows, ["load_id"], "v", {"median_value": 0.5}, totals={"row_count": F.lit(1)})
    return found.select("load_id", "row_count", F.round("median_value", 0).alias("median_value"))
