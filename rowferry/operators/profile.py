"""Counts, column statistics, widths, delimiters and key candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.text import cell_count
from rowferry.plans.spec import BYTES_PER_ROW, is_blank, quote_name

# Delimiters tried by detection.
DELIMITER_CHOICES = (",", "\t", "|", ";")

# Values longer than this are compared by their SHA-256.
LONG_VALUE = 128

# Relative deviation of the sketches that discard columns, how many deviations below
# the row count still go on to the exact count, and column sets taken in one pass.
SKETCH_DEVIATION = 0.02
SKETCH_MARGIN = 6
SETS_A_PASS = 200

# Of larger tables, about so many entries of each column set are searched for repeats
# before sets without any are counted whole.
PROBE_ROWS = 1 << 18


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def table_row_count(spark: SparkSession, table: str) -> int:
    if is_blank(table):
        raise ValueError("the table name must not be blank")
    return spark.table(table).count()


def _comparable(df: DataFrame, column: str) -> Column:
    """A column as text such that equal values give equal text."""
    dtype = df.schema[column].dataType
    value = F.col(quote_name(column))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")  # -0.0 counts as 0.0
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(value)
    elif not isinstance(dtype, (T.StringType, T.BinaryType)):
        return value.cast("string")
    # Long values cross the shuffle as their digest.
    text = value.cast("string")
    # The sign before tells a digest from a text that is spelled like one.
    return F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(F.concat(F.lit("="), text))


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column_name, value)`` of the given columns."""
    texts = df.select(*[_comparable(df, c).alias(c) for c in columns])
    return texts.unpivot([], [F.col(quote_name(c)) for c in columns], "column_name", "value")


def column_inventory(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``(column_name, data_type, null_count, distinct_count)`` of a table.

    Exact counts first reduce each column to its values inside every task, so
    a frequent value crosses the shuffle once per task. ``approximate`` uses
    sketches instead and shuffles one row per task.
    """
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    if approximate:
        stats = df.agg(
            *[
                F.struct(
                    F.count_if(F.col(quote_name(c)).isNull()).alias("null_count"),
                    F.approx_count_distinct(_comparable(df, c)).alias("distinct_count"),
                ).alias(c)
                for c in df.columns
            ]
        )
        rows = stats.unpivot([], [F.col(quote_name(c)) for c in df.columns], "column_name", "s")
        rows = rows.select("column_name", "s.null_count", "s.distinct_count")
    else:
        values = _cells(df, df.columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        rows = values.groupBy("column_name").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
    return rows.select("column_name", types[F.col("column_name")].alias("data_type"), "null_count", "distinct_count")


def candidate_keys(df: DataFrame) -> DataFrame:
    """``(column_name, row_count, null_count, is_key)``: a key is unique and never NULL."""
    # Numbers stand for the columns, whose names may be those used here.
    numbers = {str(i): c for i, c in enumerate(df.columns)}
    named = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    plain = df.select(*[F.col(quote_name(c)).alias(i) for i, c in numbers.items()])
    nulls = plain.agg(*[F.count_if(F.col(quote_name(i)).isNull()).alias(i) for i in numbers], F.count(F.lit(1)).alias("row_count"))
    counts = nulls.unpivot(["row_count"], [F.col(quote_name(i)) for i in numbers], "number", "null_count")
    repeats = (
        _cells(plain, list(numbers))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("column_name").alias("number"))
        .agg(F.max("n").alias("most"))
    )
    is_key = (F.col("null_count") == 0) & (F.coalesce(F.col("most"), F.lit(2)) == 1)
    return counts.join(repeats, "number", "left").select(
        named[F.col("number")].alias("column_name"), "row_count", "null_count", is_key.alias("is_key")
    )


def candidate_keys_composite(df: DataFrame, max_columns: int = 2) -> DataFrame:
    """``(key_columns, n_columns, row_count)``: all minimal sets of up to ``max_columns`` columns that are keys.

    A key is unique and never NULL; a set that holds a smaller key is left out;
    an empty table has none. Level by level, sets of columns without NULLs are
    discarded where the product of their columns' distinct counts is too far
    below the row count, or where a value is met twice. What remains is counted
    exactly. Names are joined by commas in the table's order. The driver sees
    numbers of columns, counts and one hash a set only.
    """
    numbers = [str(i) for i in range(len(df.columns))]
    cells = df.select(*[_hashable(df, c).alias(i) for i, c in zip(numbers, df.columns)])
    counts = cells.agg(F.count(F.lit(1)), *[F.count(F.col(quote_name(i))) for i in numbers]).first()
    rows = counts[0]
    whole = [i for i, present in zip(numbers, counts[1:]) if present == rows and rows]
    lowest = rows * (1 - SKETCH_MARGIN * SKETCH_DEVIATION)
    highest = 1 + SKETCH_MARGIN * SKETCH_DEVIATION
    distinct = dict(zip(whole, _distinct_estimates(cells, whole)))
    found: list[tuple[str, ...]] = []
    for size in range(1, max_columns + 1):
        sets = [s for s in combinations(whole, size) if not any(set(key) <= set(s) for key in found)]
        if size == 1:
            sets = [s for s in sets if distinct[s[0]] >= lowest]
        else:
            sets = [s for s in sets if prod(highest * distinct[i] for i in s) >= rows]
        found += _unique_sets(cells, sets, rows)
    spark = df.sparkSession
    keys = [(",".join(df.columns[int(i)] for i in s), len(s), rows) for s in found]
    return spark.createDataFrame(keys, "key_columns string, n_columns int, row_count long")


def _hashable(df: DataFrame, column: str) -> Column:
    """A column such that equal values have equal hashes: numbers and times as they are, others as text."""
    dtype = df.schema[column].dataType
    value = F.col(quote_name(column))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0)  # -0.0 counts as 0.0
    if isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value
    return _comparable(df, column)


def _distinct_estimates(cells: DataFrame, columns: Sequence[str]) -> list[int]:
    """Sketched distinct counts of the columns, some at a time in one pass without a shuffle of rows."""
    out: list[int] = []
    for begin in range(0, len(columns), SETS_A_PASS):
        own = columns[begin : begin + SETS_A_PASS]
        out += cells.agg(*[F.approx_count_distinct(F.col(quote_name(i)), SKETCH_DEVIATION).alias(f"n{i}") for i in own]).first()
    return out


def _unique_sets(cells: DataFrame, sets: Sequence[tuple[str, ...]], rows: int) -> list[tuple[str, ...]]:
    """The sets whose values occur in one row only, counted exactly.

    Of a large table a part of the entries is searched first; a value met twice
    there ends the search for its set, every other set is counted whole.
    """
    out: list[tuple[str, ...]] = []
    for begin in range(0, len(sets), SETS_A_PASS):
        own = list(sets[begin : begin + SETS_A_PASS])
        if rows >= 2 * PROBE_ROWS:
            shown = _repeats(cells, own, rows // PROBE_ROWS)
            own = [s for k, s in enumerate(own) if not shown.get(k)]
        shown = _repeats(cells, own)
        # Different values of one hash do not tell; such a set is counted by its values.
        out += [s for k, s in enumerate(own) if k not in shown or not (shown[k] or _repeated_values(cells, {s: F.lit(True)}))]
    return out


def _set_hash(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(*[F.col(quote_name(i)) for i in columns])


def _repeats(cells: DataFrame, sets: Sequence[tuple[str, ...]], slices: int = 1) -> dict[int, bool]:
    """Numbers of the sets with a hash met twice, and whether rows of one such hash have equal values.

    With ``slices`` only entries of one slice of the hashes take part, which
    holds all rows of its values, and those of some rows, which meet a value
    that many rows have.
    """
    if not sets:
        return {}
    entries = cells.select((F.rand(0) * slices < 1).alias("taken"), F.posexplode(F.array(*map(_set_hash, sets))).alias("k", "hash"))
    if slices > 1:
        entries = entries.where(F.col("taken") | (F.col("hash") % slices == 0))
    repeated = entries.groupBy("k", "hash").count().where("count > 1").groupBy("k").agg(F.min("hash").alias("hash")).collect()
    equal = _repeated_values(cells, {sets[r["k"]]: _set_hash(sets[r["k"]]) == r["hash"] for r in repeated})
    return {r["k"]: sets[r["k"]] in equal for r in repeated}


def _repeated_values(cells: DataFrame, wanted: Mapping[tuple[str, ...], Column]) -> set[tuple[str, ...]]:
    """The sets that have equal values in several rows among those wanted of each."""
    if not wanted:
        return set()
    sets = list(wanted)
    values = [
        F.when(wanted[s], F.struct(F.lit(k).alias("k"), F.to_json(F.array(*[F.col(quote_name(i)).cast("string") for i in s])).alias("value")))
        for k, s in enumerate(sets)
    ]
    rows = cells.where(reduce(Column.__or__, wanted.values())).select(F.inline(F.array(*values))).where("k IS NOT NULL")
    repeated = rows.groupBy("k", "value").count().where("count > 1").select("k").distinct()
    return {sets[r["k"]] for r in repeated.collect()}


def estimate_size(df: DataFrame) -> DataFrame:
    """Rows, the flat estimate of bytes, and the measured bytes of the text form."""
    measured = F.sum(F.octet_length(F.to_csv(F.struct("*"))) + F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) * F.lit(BYTES_PER_ROW)).alias("estimated_bytes"),
        measured.alias("text_bytes"),
    )


def validate_width(lines: DataFrame, sep: str) -> DataFrame:
    """One row: do all records have as many cells as the first one?

    ``lines`` comes from ``sources.record_lines`` (or ``text_lines`` where no
    cell spans lines): ``value`` and the position that tells which is the first.
    """
    widths = lines.select(cell_count(F.col("value"), sep).alias("width"), "position")
    found = widths.agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
        F.min_by("width", "position").alias("first_width"),
    )
    same = (F.col("line_count") > 0) & (F.col("min_width") == F.col("max_width"))
    return found.select("line_count", "first_width", "min_width", "max_width", F.coalesce(same, F.lit(False)).alias("is_valid"))


def bad_width_lines(lines: DataFrame, sep: str, first_width: int) -> DataFrame:
    """The lines whose cell count differs."""
    width = cell_count(F.col("value"), sep)
    return lines.select("value", width.alias("width")).where(F.col("width") != first_width)


def delimiter_widths(lines: DataFrame, choices: Sequence[str] = DELIMITER_CHOICES) -> DataFrame:
    """``(delimiter, width, lines)`` for every choice, counted in one pass."""
    tried = F.array(
        *[
            F.struct(F.lit(d).alias("delimiter"), cell_count(F.col("value"), d).alias("width"))
            for d in choices
        ]
    )
    return (
        lines.select(F.inline(tried))
        .groupBy("delimiter", "width")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def detect_delimiter(lines: DataFrame, choices: Sequence[str] = DELIMITER_CHOICES) -> DataFrame:
    """The delimiter that gives most lines one and the same width above 1.

    Ties go to the greater width, then to the earlier choice. No row if no
    delimiter occurs.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in choices]), F.col("delimiter"))
    return (
        delimiter_widths(lines, choices)
        .where("width > 1")
        .orderBy(F.col("lines").desc(), F.col("width").desc(), order)
        .limit(1)
    )


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)``, one footer-only count per table in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
