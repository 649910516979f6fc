"""Declared column type names and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Declared type name -> Spark type. Unsigned names use the next
# wider Spark type; names not listed are kept as text.
SIMPLE_TYPES = {
    "String": T.StringType(),
    "FixedString": T.StringType(),
    "UUID": T.StringType(),
    "IPv4": T.StringType(),
    "IPv6": T.StringType(),
    "Enum8": T.StringType(),
    "Enum16": T.StringType(),
    "Bool": T.BooleanType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Date": T.DateType(),
    "Date32": T.DateType(),
    "DateTime": T.TimestampNTZType(),
    "DateTime64": T.TimestampNTZType(),
}

# The largest number each unsigned type holds.
UNSIGNED_MAX = {
    "UInt8": 255,
    "UInt16": 65535,
    "UInt32": 4294967295,
    "UInt64": 18446744073709551615,
}

TRANSPARENT = ("Nullable", "LowCardinality")


def _outer(name: str) -> tuple[str, list[str]]:
    """``Map(String, Array(Int32))`` -> ``("Map", ["String", "Array(Int32)"])``."""
    match = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", name, flags=re.S)
    if not match:
        return name.strip(), []
    head, inner = match.groups()
    # A comma separates arguments only where it is not inside brackets.
    args, depth, start = [], 0, 0
    for at, char in enumerate(inner or ""):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            args.append(inner[start:at].strip())
            start = at + 1
    if inner:
        args.append(inner[start:].strip())
    return head, args


def base_name(name: str | None) -> str:
    """The type name without arguments and transparent wrappers; blank is String."""
    if not name or not name.strip():
        return "String"
    head, args = _outer(name)
    return base_name(args[0]) if head in TRANSPARENT and args else head


def spark_type(name: str | None) -> T.DataType:
    if not name or not name.strip():
        return T.StringType()
    head, args = _outer(name)
    if head in TRANSPARENT and args:
        return spark_type(args[0])
    if head == "Decimal" and args:
        return T.DecimalType(int(args[0]), int(args[1]) if len(args) > 1 else 0)
    if head == "Array" and args:
        return T.ArrayType(spark_type(args[0]))
    if head == "Map" and len(args) == 2:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if head == "Tuple" and args:
        fields = []
        for position, arg in enumerate(args, start=1):
            label, _, rest = arg.partition(" ")
            named = bool(rest) and "(" not in label
            fields.append(T.StructField(label if named else str(position), spark_type(rest if named else arg)))
        return T.StructType(fields)
    return SIMPLE_TYPES.get(head, T.StringType())


def type_name(dtype: T.DataType) -> str:
    """The declared name that stands for a Spark type (used to load existing tables)."""
    if isinstance(dtype, T.DecimalType):
        return f"Decimal({dtype.precision}, {dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return f"Array({type_name(dtype.elementType)})"
    if isinstance(dtype, T.MapType):
        return f"Map({type_name(dtype.keyType)}, {type_name(dtype.valueType)})"
    if isinstance(dtype, T.StructType):
        return "Tuple(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in dtype.fields) + ")"
    names = {
        T.BooleanType: "Bool",
        T.ByteType: "Int8",
        T.ShortType: "Int16",
        T.IntegerType: "Int32",
        T.LongType: "Int64",
        T.FloatType: "Float32",
        T.DoubleType: "Float64",
        T.DateType: "Date",
        T.TimestampType: "DateTime",
        T.TimestampNTZType: "DateTime",
    }
    return names.get(type(dtype), "String")
