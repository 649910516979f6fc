"""Joins between tables that stay balanced when one key is very frequent.

Adaptive execution splits the hot partitions of inner, semi and anti joins and
of the preserved side of left and right joins. The other side of an outer
join, and both sides of a full join, are salted here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.plans.spec import quote_name, unused_name
from rowferry.session import scratch_path

# Estimated size, by files and columns read, up to which a side is sent to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A key with more rows than this is hot: its rows are spread over several tasks.
HOT_KEY_ROWS = 5_000_000
KEY_BUCKETS = 1 << 20


def all_of(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a side, from the sizes of its files; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Ask to send a side everywhere if it is estimated small, else leave the join to the planner."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_MAX_BYTES else df


def theta_join(left: DataFrame, right: DataFrame, on: Column | None, how: str = "inner") -> DataFrame:
    """Join on any condition, or none.

    Equalities in the condition make it a hash or merge join. Without one every
    pair of rows is asked for, and it is the planner that sends the smaller
    side around or spreads the product over all tasks.
    """
    return left.join(right, F.lit(True) if on is None else on, how)


def filter_join(left: DataFrame, right: DataFrame, left_keys: Sequence[Column], right_keys: Sequence[Column], how: str) -> DataFrame:
    """Semi or anti join against the distinct right keys.

    Keys are made distinct with a partial aggregate before the shuffle, so a
    frequent right key costs no more than a rare one; NULL keys match nothing.
    """
    names = [unused_name(f"key_{i}", left.columns) for i in range(len(right_keys))]
    named = [k.alias(name) for name, k in zip(names, right_keys)]
    keys = right.where(all_of([k.isNotNull() for k in right_keys])).select(*named).distinct()
    return left.join(keys, all_of([k == F.col(name) for name, k in zip(names, left_keys)]), how)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order_by``, then by the other columns.

    ``columns`` names what is used later, so that the scan reads no more.
    """
    if not order_by:
        raise ValueError("an ANY join needs order_by columns to choose the match")
    wanted = [*keys, *order_by, *(df.columns if columns is None else columns)]
    rank = [*order_by, *(n for n in df.columns if n in wanted and n not in order_by)]
    present = all_of([F.col(quote_name(k)).isNotNull() for k in keys])
    best = F.min(F.struct(*[F.col(quote_name(n)).alias(f"r{i}") for i, n in enumerate(rank)])).alias("best")
    picked = df.where(present).groupBy(*[F.col(quote_name(k)).alias(f"k{i}") for i, k in enumerate(keys)]).agg(best)
    return picked.select(*[F.col(f"best.r{rank.index(n)}").alias(n) for n in df.columns if n in rank])


def hot_keys(df: DataFrame, keys: Sequence[Column], hot_key_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_key_rows`` rows and the salts each needs.

    Rows are first counted per hash bucket: a hot key makes its bucket crowded,
    so keys are counted only in crowded buckets and the others never cross a
    shuffle. Crowded buckets and hot keys are each at most total rows /
    ``hot_key_rows``. The result is written once to the shared folder. None if
    there is no such key.
    """
    if has_row_index(df) and df.count() <= hot_key_rows:  # footers only
        return None
    named = [k.alias(f"key_{i}") for i, k in enumerate(keys)]
    names = [f"key_{i}" for i in range(len(keys))]
    present = df.where(all_of([k.isNotNull() for k in keys])).select(*named)
    bucketed = present.select("*", F.pmod(F.xxhash64(*names), F.lit(KEY_BUCKETS)).alias("bucket"))
    rows = F.count(F.lit(1)).alias("n")
    crowded = bucketed.groupBy("bucket").agg(rows).where(F.col("n") > hot_key_rows).select("bucket")
    counted = bucketed.join(F.broadcast(crowded), "bucket", "left_semi").groupBy(*names).agg(rows)
    salts = F.ceil(F.col("n") / F.lit(max(hot_key_rows, 1))).cast("int").alias("salts")
    path = scratch_path(df.sparkSession, "hot-keys")
    counted.where(F.col("n") > hot_key_rows).select(*names, salts).write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    return None if found.isEmpty() else found


def _with_salts(df: DataFrame, keys: Sequence[Column], hot: DataFrame | None, name: str) -> DataFrame:
    """Add column ``name``: the salts of the row's key, NULL if it is not hot."""
    if hot is None:
        return df.select("*", F.lit(None).cast("int").alias(name))
    names = [unused_name(f"{name}_{i}", df.columns) for i in range(len(keys))]
    side = hot.select(*[F.col(f"key_{i}").alias(n) for i, n in enumerate(names)], F.col("salts").alias(name))
    found = df.join(broadcast_if_small(side), all_of([k == F.col(n) for n, k in zip(names, keys)]), "left")
    return found.drop(*names)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[Column],
    right_keys: Sequence[Column],
    how: str,
    hot_key_rows: int | None = None,
) -> DataFrame:
    """Outer join on key equalities that spreads hot keys of either side.

    Rows of a hot key get one salt each; the other side's rows of that key are
    repeated once per salt. A repeated row that finds no partner under one salt
    has one under another, because a hot key exists, so it is dropped.
    """
    bound = HOT_KEY_ROWS if hot_key_rows is None else hot_key_rows
    on = all_of([a == b for a, b in zip(left_keys, right_keys)])
    # Adaptive execution already splits the preserved side of left and right joins.
    hot_left = hot_keys(left, left_keys, bound) if how in ("right", "full") else None
    hot_right = hot_keys(right, right_keys, bound) if how in ("left", "full") else None
    if hot_left is None and hot_right is None:
        return left.join(right, on, how)
    if hot_left is not None and hot_right is not None:
        # Hot on both sides: salt the left, repeat the right.
        same = [f"key_{i}" for i in range(len(left_keys))]
        hot_right = hot_right.join(hot_left.select(*same), same, "left_anti")

    taken = [*left.columns, *right.columns]
    tag = {(side, what): unused_name(f"{side}_{what}", taken) for side in ("left", "right") for what in ("hash", "own", "other", "salt", "here")}

    def prepare(df, keys, own, other, side):
        # Salts follow from the row itself: a lost task's rerun repeats them.
        row_hash = F.lit(0) if own is None else F.xxhash64(*_row_identity(df))
        tagged = df.select("*", row_hash.alias(tag[side, "hash"]))
        tagged = _with_salts(_with_salts(tagged, keys, own, tag[side, "own"]), keys, other, tag[side, "other"])
        own_salt = F.pmod(F.col(tag[side, "hash"]), F.col(tag[side, "own"])).cast("int")
        others = F.col(tag[side, "other"])
        choices = F.when(others.isNotNull(), F.sequence(F.lit(0), others - 1)).otherwise(F.array(F.coalesce(own_salt, F.lit(0))))
        return tagged.select("*", F.explode(choices).alias(tag[side, "salt"]), F.lit(True).alias(tag[side, "here"]))

    ready_left = prepare(left, left_keys, hot_left, hot_right, "left")
    ready_right = prepare(right, right_keys, hot_right, hot_left, "right")
    joined = ready_left.join(ready_right, on & (F.col(tag["left", "salt"]) == F.col(tag["right", "salt"])), how)
    lonely_copy = (F.col(tag["left", "other"]).isNotNull() & F.col(tag["right", "here"]).isNull()) | (
        F.col(tag["right", "other"]).isNotNull() & F.col(tag["left", "here"]).isNull()
    )
    return joined.where(~lonely_copy).drop(*tag.values())


def has_row_index(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _row_identity(df: DataFrame) -> list[Column]:
    """What tells rows apart: file and row number, else the values themselves."""
    if has_row_index(df):
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return [F.col(quote_name(c)) for c in df.columns if df.columns.count(c) == 1] or [F.lit(0)]


def tracked_join(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    left_keys: Sequence[Column],
    right_keys: Sequence[Column],
    how: str,
    hot_key_rows: int | None = None,
) -> DataFrame:
    """Outer, semi or anti join on key equalities and more, balanced under hot keys.

    Salting does not work here, as a row may find no partner under its key. So
    the matches come from an inner join, which adaptive execution can split
    on both sides, and rows without one are told by their file and row number.
    Where no key is hot, or rows do not come straight from files, it is a
    plain join.
    """
    bound = HOT_KEY_ROWS if hot_key_rows is None else hot_key_rows
    keep_left = how in ("left", "full", "left_semi", "left_anti")
    keep_right = how in ("right", "full")
    known = (not keep_left or has_row_index(left)) and (not keep_right or has_row_index(right))
    hot = known and (
        (keep_left and hot_keys(right, right_keys, bound) is not None)
        or (keep_right and hot_keys(left, left_keys, bound) is not None)
    )
    if not hot:
        return left.join(right, on, how)
    taken = [*left.columns, *right.columns]
    tags = {side: [unused_name(f"{side}_{what}", taken) for what in ("file", "row")] for side in ("left", "right")}

    def tag(df: DataFrame, side: str) -> DataFrame:
        file, row = tags[side]
        return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))

    tagged_left = tag(left, "left") if keep_left else left
    tagged_right = tag(right, "right") if keep_right else right
    matched = tagged_left.join(tagged_right, on, "inner")
    if how in ("left_semi", "left_anti"):
        return tagged_left.join(matched.select(*tags["left"]).distinct(), tags["left"], how).drop(*tags["left"])

    def blanks(df: DataFrame) -> list[Column]:
        return [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]

    every = [t for side in tags.values() for t in side]
    result = matched.drop(*every)
    if keep_left:
        alone = tagged_left.join(matched.select(*tags["left"]).distinct(), tags["left"], "left_anti")
        result = result.union(alone.drop(*every).select("*", *blanks(right)))
    if keep_right:
        alone = tagged_right.join(matched.select(*tags["right"]).distinct(), tags["right"], "left_anti")
        result = result.union(alone.drop(*every).select(*blanks(left), "*"))
    return result


def array_join(df: DataFrame, column: Column, item: str, keep_empty: bool = False, position: str | None = None) -> DataFrame:
    """One row per array element; ``keep_empty`` also keeps rows without elements."""
    if position:
        unfold = F.posexplode_outer if keep_empty else F.posexplode
        return df.select("*", unfold(column).alias(position, item))
    unfold = F.explode_outer if keep_empty else F.explode
    return df.select("*", unfold(column).alias(item))
