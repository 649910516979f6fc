"""Strict text-to-type conversion as Column expressions.

``cast`` in Spark is more lenient than the formats accepted here (it trims,
takes partial dates, reads ``t`` as true), so each conversion pairs a shape
check with ``try_cast``. Everything stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.types import UNSIGNED_MAX, base_name, spark_type
from rowferry.plans.spec import quote_name

# Accepted text shapes. They are tight on purpose: a failing
# ``try_cast`` costs an exception, a failing pattern does not.
BLANKS = r"[\x00-\x20]*"
DIGITS = r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
HEX_DIGITS = r"0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
DAY = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
WHOLE_NUMBER = r"\A[+-]?[0-9]+\z"
DECIMAL_NUMBER = rf"\A{BLANKS}[+-]?{DIGITS}{BLANKS}\z"
REAL_NUMBER = rf"\A{BLANKS}[+-]?(NaN|Infinity|({DIGITS}|{HEX_DIGITS})[fFdD]?){BLANKS}\z"
ISO_DATE = rf"\A{DAY}\z"
ISO_DATETIME = rf"\A{DAY}[Tt]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{{0,9}})?)?\z"
UUID_TEXT = r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")

# Bits of the signed whole-number types.
WHOLE_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def to_whole(text: Column, dtype: str) -> Column:
    wide = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
    if dtype == "bigint":
        return wide
    bound = 1 << (WHOLE_BITS[dtype] - 1)
    return F.when(wide.between(-bound, bound - 1), wide.cast(dtype))


def to_unsigned(text: Column, name: str) -> Column:
    wide = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("decimal(38,0)"))
    in_range = wide.between(F.lit(0), F.lit(str(UNSIGNED_MAX[name])).cast("decimal(38,0)"))
    return F.when(in_range, wide.cast(spark_type(name)))


def to_real(text: Column, dtype: str = "double") -> Column:
    return F.when(text.rlike(REAL_NUMBER), text.try_cast(dtype))


def to_date(text: Column) -> Column:
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def to_datetime(text: Column) -> Column:
    return F.when(text.rlike(ISO_DATETIME), F.upper(text).try_cast("timestamp_ntz"))


def to_bool(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_uuid(text: Column) -> Column:
    return F.when(text.rlike(UUID_TEXT), F.lower(text))


def cast_text(text: Column, name: str | None) -> Column:
    """Convert text to the declared type: empty text and misfits become NULL."""
    head = base_name(name)
    target = spark_type(name)
    if head in UNSIGNED_MAX:
        return to_unsigned(text, head)
    if head == "UUID":
        return to_uuid(text)
    if isinstance(target, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return to_whole(text, target.simpleString())
    if isinstance(target, (T.FloatType, T.DoubleType)):
        return to_real(text, target.simpleString())
    if isinstance(target, T.DecimalType):
        return F.when(text.rlike(DECIMAL_NUMBER), text.try_cast(target))
    if isinstance(target, T.DateType):
        return to_date(text)
    if isinstance(target, T.TimestampNTZType):
        return to_datetime(text)
    if isinstance(target, T.BooleanType):
        return to_bool(text)
    if isinstance(target, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(text != "", F.from_json(text, target))
    return F.nullif(text, F.lit(""))


def is_rejected(text: Column, name: str | None) -> Column:
    """True where there is text that does not fit the declared type."""
    return text.isNotNull() & (text != "") & cast_text(text, name).isNull()


def require_cast(text: Column, name: str) -> Column:
    """Like ``cast_text`` but fails the job on a misfit, NULL and empty text included."""
    message = F.concat(F.lit("Cannot convert '"), F.coalesce(text, F.lit("")), F.lit(f"' to {name}"))
    return F.coalesce(cast_text(text, name), F.raise_error(message).cast(spark_type(name)))


def typed_columns(types: Mapping[str, str]) -> list[Column]:
    """The text columns of these names converted to their types."""
    return [cast_text(F.col(quote_name(c)), t).alias(c) for c, t in types.items()]


def typed_projection(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One projection from text columns to the declared types, in declared order."""
    return df.select(*typed_columns(types))
