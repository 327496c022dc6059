"""Warehouse type names as column expressions: parse, family, canonical text, lattice."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that mean the same type.
TYPE_ALIASES = {
    "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR", "CHARACTER": "VARCHAR",
    "DECIMAL": "NUMBER", "NUMERIC": "NUMBER",
    "INT": "INTEGER", "BIGINT": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "BYTEINT": "INTEGER",
    "DOUBLE": "FLOAT", "DOUBLE PRECISION": "FLOAT", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "FLOAT",
    "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ",
}
# The family each base type belongs to.
TYPE_FAMILIES = {
    "NUMBER": "numeric", "INTEGER": "numeric", "FLOAT": "numeric", "VARCHAR": "text", "BINARY": "binary",
    "BOOLEAN": "boolean", "DATE": "temporal", "TIME": "temporal", "TIMESTAMP_NTZ": "temporal",
    "TIMESTAMP_LTZ": "temporal", "TIMESTAMP_TZ": "temporal", "VARIANT": "semi", "OBJECT": "semi", "ARRAY": "semi",
}
# Defaults of unparameterised types.
NUMBER_DEFAULT = (38, 0)
VARCHAR_MAX = 16777216

# Native integers keep their width, so that int -> bigint is a widening and bigint -> int a narrowing.
_SPARK_TYPES = {
    T.ByteType: "NUMBER(3,0)", T.ShortType: "NUMBER(5,0)", T.IntegerType: "NUMBER(10,0)", T.LongType: "NUMBER(19,0)",
    T.FloatType: "FLOAT", T.DoubleType: "FLOAT", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
    T.BinaryType: "BINARY", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP_NTZ", T.TimestampType: "TIMESTAMP_LTZ",
    T.VariantType: "VARIANT", T.StructType: "OBJECT", T.MapType: "OBJECT", T.ArrayType: "ARRAY",
}


def spark_type_text(dt: T.DataType) -> str:
    """Warehouse spelling of a Spark type."""
    if isinstance(dt, T.DecimalType):
        return f"NUMBER({dt.precision},{dt.scale})"
    if isinstance(dt, (T.VarcharType, T.CharType)):
        return f"VARCHAR({dt.length})"
    return _SPARK_TYPES.get(type(dt), dt.simpleString().upper())


def spark_type_parts(dt: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """(base, precision, scale, length) of a Spark type."""
    base, _, args = spark_type_text(dt).rstrip(")").partition("(")
    numbers = [int(x) for x in args.split(",")] if args else []
    if base == "NUMBER":
        return base, *(numbers or NUMBER_DEFAULT), None
    return base, None, None, (numbers[0] if numbers else VARCHAR_MAX) if base == "VARCHAR" else None


def family_of(dt: T.DataType) -> str:
    """Family of a Spark type, for building expressions from a schema."""
    return TYPE_FAMILIES.get(spark_type_text(dt).split("(")[0], "other")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[key]


def _type_struct(base: Column, precision: Column, scale: Column, length: Column) -> Column:
    number = base == "NUMBER"
    return F.struct(
        base.alias("base"),
        F.when(number, F.coalesce(precision, F.lit(NUMBER_DEFAULT[0]))).alias("precision"),
        F.when(number, F.coalesce(scale, F.lit(NUMBER_DEFAULT[1]))).alias("scale"),
        F.when(base == "VARCHAR", F.coalesce(length, F.lit(VARCHAR_MAX))).alias("length"),
    )


def parse_type(text: Column) -> Column:
    """struct(base, precision, scale, length) of a type name; integers become NUMBER(38,0)."""
    up = F.upper(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(up, r"\(\s*(\d+)", 1).try_cast("int")
    second = F.regexp_extract(up, r",\s*(\d+)\s*\)", 1).try_cast("int")
    name = F.trim(F.regexp_extract(up, r"^([^(]*)", 1))
    alias = F.coalesce(_lookup(TYPE_ALIASES, name), name)
    integer = alias == "INTEGER"
    base = F.when(integer, F.lit("NUMBER")).otherwise(alias)
    return _type_struct(base, F.when(~integer, first), F.when(~integer, second), first)


def catalog_type(data_type: Column, precision: Column, scale: Column, char_length: Column) -> Column:
    """The same struct, rebuilt from catalog fields (type name, precision, scale, length)."""
    name = F.upper(F.coalesce(data_type, F.lit("")))
    return _type_struct(F.coalesce(_lookup(TYPE_ALIASES, name), name), precision, scale,
                        F.when(char_length != 0, char_length))


def type_text(parsed: Column) -> Column:
    """Canonical spelling: NUMBER(p,s), VARCHAR(n) only when bounded, else the base name."""
    base = parsed["base"]
    return (
        F.when(base == "NUMBER", F.concat(F.lit("NUMBER("), parsed["precision"].cast("string"), F.lit(","),
                                          parsed["scale"].cast("string"), F.lit(")")))
        .when((base == "VARCHAR") & (parsed["length"] != VARCHAR_MAX),
              F.concat(F.lit("VARCHAR("), parsed["length"].cast("string"), F.lit(")")))
        .otherwise(base)
    )


def contract_type(parsed: Column) -> Column:
    """Lower-case spelling used in contracts and column maps."""
    return F.lower(type_text(parsed))


def spark_cast_type(contract: str) -> str:
    """Spark type to cast to for a contract type such as `number(10,2)` or `varchar(20)`."""
    name, _, args = contract.strip().lower().partition("(")
    args = args.rstrip(") ")
    alias = TYPE_ALIASES.get(name.strip().upper(), name.strip().upper())
    if alias == "INTEGER":
        return "decimal(38,0)"
    if alias == "NUMBER":
        return f"decimal({args or '38,0'})"
    plain = {"VARCHAR": "string", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date", "BINARY": "binary",
             "TIMESTAMP_NTZ": "timestamp_ntz", "TIMESTAMP_LTZ": "timestamp", "VARIANT": "variant"}
    return plain.get(alias, name.strip())


def type_family(parsed: Column) -> Column:
    return F.coalesce(_lookup(TYPE_FAMILIES, parsed["base"]), F.lit("other"))


def compare_types(old: Column, new: Column) -> Column:
    """same | widening | widening_lossy | narrowing | incompatible, for two parsed types."""
    both_number = (old["base"] == "NUMBER") & (new["base"] == "NUMBER")
    both_text = (old["base"] == "VARCHAR") & (new["base"] == "VARCHAR")
    keeps_digits = (new["scale"] >= old["scale"]) & (
        new["precision"] - new["scale"] >= old["precision"] - old["scale"])
    lossy = ((old["base"] == "NUMBER") & (new["base"] == "FLOAT")) | (
        (type_family(old) == "numeric") & (new["base"] == "VARCHAR"))
    return (
        F.when(old.eqNullSafe(new), "same")
        .when(both_number, F.when(keeps_digits, "widening").otherwise("narrowing"))
        .when(both_text, F.when(new["length"] >= old["length"], "widening").otherwise("narrowing"))
        .when((old["base"] == "DATE") & new["base"].startswith("TIMESTAMP"), "widening")
        .when(lossy, "widening_lossy")
        .otherwise("incompatible")
    )


def canonical_text(value: Column, dt: T.DataType) -> Column:
    """One spelling per value across the types of a family (1.50, 1.5 and 1.5000 all give `1.5`)."""
    def trimmed(text: Column) -> Column:
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))

    if isinstance(dt, T.DecimalType) and dt.scale > 0:
        return trimmed(value.cast("string"))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        whole = number.try_cast("bigint")
        plain = number.try_cast("decimal(38,15)")
        return (F.when(whole.cast("double") == number, whole.cast("string"))
                .when(plain.cast("double") == number, trimmed(plain.cast("string")))
                .otherwise(number.cast("string")))
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(dt, T.BinaryType):
        return F.hex(value)
    return value.cast("string")
