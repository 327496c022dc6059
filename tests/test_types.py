import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwarden.functions import types as t


def _one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if k in ('p', 's', 'n') else 'string'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("old,new,relation", [
    ("NUMBER(10,2)", "NUMBER(18,2)", "widening"), ("NUMBER(18,2)", "NUMBER(10,2)", "narrowing"),
    ("NUMBER(10,2)", "NUMBER(10,4)", "narrowing"), ("NUMBER(10,2)", "NUMBER(12,4)", "widening"),
    ("NUMBER(38,0)", "number(38, 0)", "same"), ("INT", "BIGINT", "same"), ("NUMBER(10,2)", "FLOAT", "widening_lossy"),
    ("FLOAT", "NUMBER(10,2)", "incompatible"), ("NUMBER(10,2)", "VARCHAR", "widening_lossy"),
    ("FLOAT", "TEXT", "widening_lossy"), ("VARCHAR(20)", "VARCHAR(200)", "widening"), ("VARCHAR", "VARCHAR(20)", "narrowing"),
    ("STRING", "TEXT", "same"), ("DATE", "TIMESTAMP_NTZ", "widening"), ("TIMESTAMP_NTZ", "TIMESTAMP_TZ", "incompatible"),
    ("DATETIME", "TIMESTAMP", "same"), ("TIMESTAMP_NTZ(9)", "TIMESTAMP_NTZ(3)", "same"), ("BOOLEAN", "VARCHAR", "incompatible"),
    ("VARCHAR", "BOOLEAN", "incompatible"), ("BINARY(8)", "BINARY(16)", "same"),
])
def test_lattice(spark, old, new, relation):
    got = _one(spark, t.compare_types(t.parse_type(F.col("a")), t.parse_type(F.col("b"))), a=old, b=new)
    assert got == relation


def test_native_integers_keep_their_width(spark):
    assert t.spark_type_text(T.IntegerType()) == "NUMBER(10,0)" and t.spark_type_text(T.LongType()) == "NUMBER(19,0)"
    got = _one(spark, t.compare_types(t.parse_type(F.col("a")), t.parse_type(F.col("b"))),
               a=t.spark_type_text(T.IntegerType()), b=t.spark_type_text(T.LongType()))
    assert got == "widening"


@pytest.mark.parametrize("dt", [T.ByteType(), T.LongType(), T.DecimalType(12, 3), T.DoubleType(), T.StringType(),
                                T.VarcharType(9), T.BooleanType(), T.DateType(), T.TimestampType(), T.BinaryType(),
                                T.ArrayType(T.LongType())])
def test_parts_agree_with_the_parser(spark, dt):
    parsed = _one(spark, t.parse_type(F.col("a")), a=t.spark_type_text(dt))
    assert tuple(parsed) == t.spark_type_parts(dt)
    assert _one(spark, t.type_family(t.parse_type(F.col("a"))), a=t.spark_type_text(dt)) == t.family_of(dt)


@pytest.mark.parametrize("text,canonical,contract", [
    ("decimal(10,2)", "NUMBER(10,2)", "number(10,2)"), ("INT", "NUMBER(38,0)", "number(38,0)"), ("varchar(20)", "VARCHAR(20)", "varchar(20)"),
    ("STRING", "VARCHAR", "varchar"), ("DOUBLE PRECISION", "FLOAT", "float"), ("timestamp", "TIMESTAMP_NTZ", "timestamp_ntz"),
    ("GEOGRAPHY", "GEOGRAPHY", "geography"),
])
def test_texts(spark, text, canonical, contract):
    assert _one(spark, t.type_text(t.parse_type(F.col("a"))), a=text) == canonical
    assert _one(spark, t.contract_type(t.parse_type(F.col("a"))), a=text) == contract


def test_catalog_fields(spark):
    col = t.type_text(t.catalog_type(F.col("a"), F.col("p"), F.col("s"), F.col("n")))
    assert _one(spark, col, a="decimal", p=10, s=2, n=None) == "NUMBER(10,2)"
    assert _one(spark, col, a="number", p=None, s=None, n=None) == "NUMBER(38,0)"
    assert _one(spark, col, a="TEXT", p=None, s=None, n=20) == "VARCHAR(20)"
    assert _one(spark, col, a="TEXT", p=None, s=None, n=0) == "VARCHAR"


def test_canonical_text_is_one_spelling_per_value(spark):
    df = spark.sql("select cast(1.50 as decimal(10,2)) a, cast(1.5 as decimal(18,4)) b, 1.5d c, cast(100 as bigint) d, "
                   "cast(100 as decimal(10,2)) e, 100d f, 12345678.25d g, cast(12345678.25 as decimal(12,4)) h, 1e300d i")
    row = df.select(*[t.canonical_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert row["a"] == row["b"] == row["c"] == "1.5"
    assert row["d"] == row["e"] == row["f"] == "100"
    assert row["g"] == row["h"] == "12345678.25"
    assert row["i"] == "1.0E300"
