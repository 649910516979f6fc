"""Counts and group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.functions.text import parse_datetime
from rowferry.operators.profile import row_count
from rowferry.operators.sets import average_by, count_by, union_distinct
from rowferry.plans import ExportSpec, JoinSpec, compile_export, count_export
from workloads.common import table, tables

WITH_CUSTOMER = (JoinSpec("customer", "INNER JOIN", "orders.o_custkey = customer.c_custkey"),)


def row_count_query(spark, folder):
    return row_count(table(spark, folder, "lineitem"))


def count_projection(spark, folder):
    """``COUNT(*)`` as the only column counts the joined rows."""
    spec = ExportSpec("orders", ("orders.count(*)",), WITH_CUSTOMER)
    return compile_export(spec, tables(spark, folder)).withColumnRenamed("COUNT(*)", "n")


def joined_count(spark, folder):
    """Rows before limiting."""
    spec = ExportSpec("orders", ("o_orderkey", "customer.c_name"), WITH_CUSTOMER, limit=10)
    return count_export(spec, tables(spark, folder))


def avg_by_group(spark, folder):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    averages = average_by(table(spark, folder, "orders"), "o_orderpriority", price, "avg_price")
    return averages.select("o_orderpriority", F.round(F.col("avg_price").cast("double"), 4).alias("avg_price"))


def count_by_year(spark, folder):
    year = F.year("o_orderdate").alias("year")
    return count_by(table(spark, folder, "orders"), year, "order_count").orderBy("year")


def count_by_parsed_year(spark, folder):
    """The year of a date that is kept as text in several spellings."""
    day = F.col("o_orderdate")
    spelled = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    orders = table(spark, folder, "orders").select(spelled.alias("date"))
    year = F.year(parse_datetime(F.col("date"), ["yyyy-MM-dd HH:mm", "dd/MM/yyyy"])).alias("year")
    return count_by(orders, year, "order_count").orderBy("year")


def union_distinct_query(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return union_distinct(names, table(spark, folder, "supplier").select("s_nationkey"))


QUERIES = {
    "row_count": row_count_query,
    "count_projection": count_projection,
    "joined_count": joined_count,
    "avg_by_group": avg_by_group,
    "count_by_year": count_by_year,
    "count_by_parsed_year": count_by_parsed_year,
    "union_distinct": union_distinct_query,
}

SQL = {
    "row_count": "SELECT count(*) AS row_count FROM lineitem",
    "count_projection": "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey",
    "joined_count": "SELECT count(*) AS total_rows FROM orders JOIN customer ON o_custkey = c_custkey",
    "avg_by_group": (
        "SELECT o_orderpriority, round(CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 4) AS avg_price "
        "FROM orders GROUP BY o_orderpriority"
    ),
    "count_by_year": (
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS order_count FROM orders GROUP BY 1"
    ),
    "count_by_parsed_year": (
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS order_count FROM orders GROUP BY 1"
    ),
    "union_distinct": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
}
