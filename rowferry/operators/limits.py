"""Limits, top-k and sorts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from rowferry.operators.joins import has_row_index
from rowferry.plans.spec import PREVIEW_ROWS, TABLE_HEAD_ROWS, quote_name, unused_name
from rowferry.session import settled, shared_folder

# Up to this many rows a plain limit runs in one task; the rows kept are the same beyond.
ONE_TASK_ROWS = 1_000_000

ROW_BITS = 33  # low bits of monotonically_increasing_id: row number in its partition

# Rows of the keys that are drawn to find where a limit ends; they decide how many rows are sorted, not which are kept.
SAMPLED_KEYS = 100_000
# A limit is cut again among the rows that are left while they exceed it by this factor.
NEAR_ENOUGH = 1.5
CUT_ROUNDS = 4

# Types whose values come back from a literal unchanged; times go by their microseconds.
CUT_TYPES = (T.IntegralType, T.FractionalType, T.StringType, T.DateType, T.BooleanType)


@dataclass(frozen=True)
class OrderKey:
    """A column to sort by. Nulls stand first, in descending order last, unless ``nulls_last`` says otherwise."""

    name: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last_nulls(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    @property
    def sort(self) -> Column:
        column = F.col(quote_name(self.name))
        if self.descending:
            return column.desc_nulls_last() if self.last_nulls else column.desc_nulls_first()
        return column.asc_nulls_last() if self.last_nulls else column.asc_nulls_first()

    def before(self, value: object) -> Column:
        """Whether a row's key stands in front of the value; the key equals it where neither does."""
        column = F.col(quote_name(self.name))
        if value is None:
            return column.isNotNull() if self.last_nulls else F.lit(False)
        ahead = column > F.lit(value) if self.descending else column < F.lit(value)
        return F.coalesce(ahead, F.lit(not self.last_nulls))


def preview_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    return df.limit(n if n and n > 0 else PREVIEW_ROWS)


def table_head(df: DataFrame, n: int = TABLE_HEAD_ROWS) -> DataFrame:
    return df.limit(n)


def first_rows(
    df: DataFrame, n: int | None, order_by: Sequence[Column | OrderKey] = (), one_task_rows: int | None = None, sampled: int = SAMPLED_KEYS
) -> DataFrame:
    """At most ``n`` rows; no limit if ``n`` is not positive.

    A plain limit moves its rows through one task, so above ``one_task_rows``
    the rows are fixed by a checkpoint and each partition keeps its share of
    the first ``n``: exact, and as parallel as the input. Where all of
    ``order_by`` are ``OrderKey``s, only rows up to a measured cut are sorted
    (`rows_to_cut`); other columns hide their direction, so all rows are.
    """
    if not n or n <= 0:
        return df
    sorts = [key.sort if isinstance(key, OrderKey) else key for key in order_by]
    if n <= (ONE_TASK_ROWS if one_task_rows is None else one_task_rows):
        return (df.orderBy(*sorts) if sorts else df).limit(n)
    shared_folder(df.sparkSession)
    if sorts and all(isinstance(key, OrderKey) for key in order_by) and _can_cut(df, order_by):
        df = rows_to_cut(df, n, order_by, sampled)
    fixed = (spread_sort(df, sorts) if sorts else df).checkpoint()
    part, row, before = (unused_name(name, df.columns) for name in ("part", "row_in_part", "before"))
    numbered = fixed.select(
        "*",
        F.spark_partition_id().alias(part),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias(row),
    )
    sizes = fixed.groupBy(F.spark_partition_id().alias(part)).agg(F.count(F.lit(1)).alias("rows"))
    # One row per partition, so this window and the broadcast stay small.
    running = F.sum("rows").over(Window.orderBy(part))
    earlier = sizes.select(part, (running - F.col("rows")).alias(before))
    kept = numbered.join(F.broadcast(earlier), part).where(F.col(before) + F.col(row) < n)
    return kept.drop(part, row, before)


def _can_cut(df: DataFrame, keys: Sequence[OrderKey]) -> bool:
    """Whether the rows can be written once and their keys be compared with literals."""
    names = [c.lower() for c in df.columns]
    kinds = [df.select(quote_name(key.name)).schema[0].dataType for key in keys if names.count(key.name.lower()) == 1]
    return len(set(names)) == len(names) and len(kinds) == len(keys) and all(isinstance(k, (*CUT_TYPES, T.TimestampType)) for k in kinds)


def rows_to_cut(df: DataFrame, n: int, keys: Sequence[OrderKey], sampled: int = SAMPLED_KEYS) -> DataFrame:
    """Rows that hold the first ``n`` in the order of the keys, and few others.

    A sample of the keys, one row of which reaches the driver, proposes a cut
    behind the ``n``-th row. The rows up to it are counted exactly: a cut with
    fewer than ``n`` rows is dropped for a later one, one with many more is
    refined among the rows that it leaves. Where a hot key leaves too many rows
    equal, a hash of the whole row tells them apart; rows that equal the cut in
    every column all stay. Rows not straight from files are
    written once, since they are read several times.
    """
    if not has_row_index(df):
        df = settled(df, "limit")
    times = {key.name: unused_name(f"micros_{i}", df.columns) for i, key in enumerate(keys) if isinstance(df.schema[key.name].dataType, T.TimestampType)}
    tie = unused_name("row_hash", df.columns)
    kept = df.withColumns({name: F.unix_micros(F.col(quote_name(time))) for time, name in times.items()})
    rows = kept.count()
    order = [OrderKey(times.get(key.name, key.name), key.descending, key.nulls_last) for key in keys]
    # The hash reads all columns, so it is only asked where the keys alone leave too many equals.
    kept, rows = _cut(kept, rows, n, order, sampled)
    if rows > n * NEAR_ENOUGH and rows > sampled:
        kept, rows = _cut(kept.withColumn(tie, _row_hash(df)), rows, n, [*order, OrderKey(tie)], sampled)
    return kept.drop(tie, *times.values())


def _cut(kept: DataFrame, rows: int, n: int, order: Sequence[OrderKey], sampled: int) -> tuple[DataFrame, int]:
    """The rows up to a cut behind the first ``n``, and their number; reads the columns of the order only."""
    margin = 5
    for _ in range(CUT_ROUNDS):
        if rows <= n * NEAR_ENOUGH or rows <= sampled:
            break
        place = n / rows * sampled
        # So many deviations beyond the expected place that a cut in front of the n-th row is rare.
        offset = math.ceil(place + margin * math.sqrt(place) + margin)
        drawn = kept.select(*(quote_name(key.name) for key in order)).sample(min(1.0, sampled / rows), seed=offset)
        cut = drawn.orderBy(*(key.sort for key in order)).offset(offset).limit(1).collect()
        if not cut:
            break
        closer = kept.where(~_behind(order, list(cut[0])))
        found = closer.count()
        if found < n:
            margin *= 2
        elif found == rows:
            break
        else:
            kept, rows = closer, found
    return kept, rows


def _behind(order: Sequence[OrderKey], cut: Sequence[object]) -> Column:
    """Whether a row stands behind the cut: equal in the keys before, and behind it in the next."""

    def equal(key: OrderKey, value: object) -> Column:
        column = F.col(quote_name(key.name))
        return column.isNull() if value is None else column.eqNullSafe(F.lit(value))

    def from_last(later: Column, pair: tuple[OrderKey, object]) -> Column:
        key, value = pair
        return F.when(equal(key, value), later).otherwise(~key.before(value))

    return reduce(from_last, reversed(list(zip(order, cut))), F.lit(False))


def first_rows_of_files(df: DataFrame, n: int | None) -> DataFrame:
    """``first_rows`` for a Parquet-backed table: the first ``n`` rows in file order.

    Row counts come from file footers; only the files that hold the first
    ``n`` rows are read, without a shuffle and with one task per file split.
    """
    if not n or n <= 0:
        return df
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.groupBy(path.alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    running = F.sum("rows").over(Window.orderBy("file"))
    # Files count in the order of their paths, so one path tells where the limit ends.
    last = files.select("file", (running - F.col("rows")).alias("before")).where(F.col("before") < n).orderBy(F.desc("file")).head()
    if last is None:
        return df
    return df.where(path <= last.file).where((path < last.file) | (row < n - last.before))


def top_groups(df: DataFrame, key: Column | str, measure: Column, k: int, descending: bool = True) -> DataFrame:
    """Group, aggregate, keep the ``k`` best groups; ties go to the smaller key."""
    grouped = df.groupBy(key).agg(measure)
    key_name, measure_name = grouped.columns
    best = F.col(quote_name(measure_name))
    return grouped.orderBy(best.desc() if descending else best.asc(), F.col(quote_name(key_name))).limit(k)


def spread_sort(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Global sort that can cut one very frequent value into several partitions.

    Equal values are ordered by a hash of the row, which gives the range
    partitioner something to cut by.
    """
    return df.orderBy(*order_by, _row_hash(df))


def _row_hash(df: DataFrame) -> Column:
    unique = [F.col(quote_name(c)) for c in df.columns if df.columns.count(c) == 1]
    return F.xxhash64(*unique) if unique else F.lit(0).cast("long")


def pinned_sort(df: DataFrame, column: str, pinned: str) -> DataFrame:
    """Rows with one pinned value first, the rest ascending."""
    name = F.col(quote_name(column))
    return spread_sort(df, [name != F.lit(pinned), name])
