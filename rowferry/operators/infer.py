"""Column type inference in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.casting import (
    FALSE_WORDS,
    REAL_NUMBER,
    TRUE_WORDS,
    UUID_TEXT,
    WHOLE_NUMBER,
    to_date,
    to_datetime,
)
from rowferry.plans.spec import quote_name

# Candidate types, most specific first.
CANDIDATES = ("Int32", "Int64", "Float64", "Date", "DateTime", "Bool", "UUID")
FALLBACK = "String"
BIT = {name: 1 << position for position, name in enumerate(CANDIDATES)}

def fitting_types(text: Column) -> Column:
    """Bit set of the candidate types one text fits; NULL for NULL and empty text.

    The shapes exclude each other apart from whole numbers. First character
    and length settle most cells before any pattern is tried.
    """
    first, size = F.ascii(text), F.length(text)
    numeric = first.between(ord("0"), ord("9")) | first.isin(ord("+"), ord("-"), ord("."))
    whole = text.try_cast("bigint")
    whole_bits = (
        F.when(whole.isNull(), F.lit(BIT["Float64"]))
        .when(
            whole.between(F.lit(-(1 << 31)), F.lit((1 << 31) - 1)),
            F.lit(BIT["Int32"] | BIT["Int64"] | BIT["Float64"]),
        )
        .otherwise(F.lit(BIT["Int64"] | BIT["Float64"]))
    )
    flag_bits = F.when(text.isin("0", "1"), F.lit(BIT["Bool"])).otherwise(F.lit(0))
    may_be_real = numeric | (first <= ord(" ")) | first.isin(ord("N"), ord("I"))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("int"))
        .when(numeric & text.rlike(WHOLE_NUMBER), whole_bits.bitwiseOR(flag_bits))
        .when((size == 10) & to_date(text).isNotNull(), F.lit(BIT["Date"]))
        .when(size.between(16, 29) & to_datetime(text).isNotNull(), F.lit(BIT["DateTime"]))
        .when((size == 36) & text.rlike(UUID_TEXT), F.lit(BIT["UUID"]))
        .when(may_be_real & text.rlike(REAL_NUMBER), F.lit(BIT["Float64"]))
        .when((size <= 5) & F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(BIT["Bool"]))
        .otherwise(F.lit(0))
    )


def infer_types(df: DataFrame) -> DataFrame:
    """``(column_name, type_name)``: the most specific type fitting all cells.

    Cells are put one below the other so that one small generated function
    tests them all. A task sends each (column, bit set) once, however many
    rows it reads.
    """
    columns = [F.col(quote_name(c)) for c in df.columns]
    cells = df.unpivot([], columns, "column_name", "value")
    # One NULL cell per column keeps the columns of a file without rows.
    names = F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column_name")
    cells = cells.unionByName(df.sparkSession.range(1).select(names, F.lit(None).cast("string").alias("value")))
    seen = cells.select("column_name", fitting_types(F.col("value")).alias("bits")).distinct()
    fits = seen.groupBy("column_name").agg(F.bit_and("bits").alias("bits"))
    chosen = F.lit(None).cast("string")
    for name in reversed(CANDIDATES):
        chosen = F.when(F.col("bits").bitwiseAND(F.lit(BIT[name])) != 0, F.lit(name)).otherwise(chosen)
    return fits.select("column_name", F.coalesce(chosen, F.lit(FALLBACK)).alias("type_name"))


def suggested_types(df: DataFrame) -> dict[str, str]:
    """``infer_types`` as a mapping in column order, ready for a load."""
    found = {r.column_name: r.type_name for r in infer_types(df).collect()}
    return {c: found[c] for c in df.columns}
