"""Set operations and group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either input once; duplicates are removed per task before the shuffle."""
    return a.union(b).distinct()


def append_union(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Bag union by column name: unknown columns are skipped, absent ones are NULL."""
    known = [c for c in added.columns if c in existing.columns]
    return existing.unionByName(added.select(*known), allowMissingColumns=True)


def average_by(df: DataFrame, key: Column | str, value: Column, name: str = "average") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(name))


def count_by(df: DataFrame, key: Column, name: str = "row_count") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
