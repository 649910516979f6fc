"""Tables of the catalog: scan, preview, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rowferry.operators.limits import preview_rows
from rowferry.operators.profile import table_inventory
from rowferry.plans.spec import is_blank, quote_name


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    if is_blank(table):
        raise ValueError("the table name must not be blank")
    return spark.table(table)


def preview_table(df: DataFrame, columns: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """Some or all columns, 100 rows unless told otherwise."""
    return preview_rows(df.select(*[quote_name(c) for c in columns or df.columns]), n)


def catalog_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Every table of a database with its row count."""
    prefix = f"{quote_name(database)}." if database else ""
    names = [t.name for t in spark.catalog.listTables(database) if not (database and t.isTemporary)]
    tables = {name: spark.table(prefix + quote_name(name)) for name in sorted(names)}
    if not tables:
        return spark.createDataFrame([], "table_name string, row_count bigint")
    return table_inventory(tables)
