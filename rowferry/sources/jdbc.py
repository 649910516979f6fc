"""Scan a table of an external database through its JDBC driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; with a numeric column and its bounds the scan is cut
    into ``partitions`` range queries, otherwise it is one query."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    options |= {k: v for k, v in (("user", user), ("password", password), ("driver", driver)) if v is not None}
    if partition_column:
        if bounds is None or not partitions:
            raise ValueError("a partitioned scan needs the bounds of its column and the number of partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **settings) -> DataFrame:
    """Column pruning, filters and limits are pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()
