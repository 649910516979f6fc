"""Limits, top-k, sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowferry.operators.limits import OrderKey, first_rows, first_rows_of_files, pinned_sort, table_head, top_groups
from rowferry.plans import ExportSpec, JoinSpec, export_preview, prepare_export
from workloads.common import table, tables

ORDERS = ExportSpec(
    "orders",
    ("o_orderkey", "o_totalprice", "customer.c_name"),
    (JoinSpec("customer", "LEFT JOIN", "orders.o_custkey = customer.c_custkey"),),
    order_by=("o_orderkey",),
)


def limit_default(spark, folder):
    """Not a positive number: 100 rows."""
    return export_preview(ORDERS, tables(spark, folder), 0)


def limit_preview(spark, folder):
    return export_preview(ORDERS, tables(spark, folder), 25)


def limit_export(spark, folder):
    spec = ExportSpec(ORDERS.table, ORDERS.columns, ORDERS.joins, limit=1200, order_by=ORDERS.order_by)
    return prepare_export(spec, tables(spark, folder))


def limit_export_none(spark, folder):
    """A limit that is not positive means the whole table."""
    return prepare_export(ExportSpec("events", ("event_id", "event_type"), limit=0), tables(spark, folder))


def limit_export_large(spark, folder):
    """A large limit takes its rows from the first partitions of the sorted rows, in parallel."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return first_rows(lines, 4321, order, one_task_rows=1000)


def limit_export_cut(spark, folder):
    """A large limit finds where it ends before it sorts; dates descend, the keys of equal dates ascend."""
    orders = table(spark, folder, "orders").select("o_orderdate", "o_custkey", "o_orderkey")
    order = [OrderKey("o_orderdate", descending=True), OrderKey("o_custkey"), OrderKey("o_orderkey")]
    return first_rows(orders, 1500, order, one_task_rows=1000, sampled=2000)


def limit_export_joined_cut(spark, folder):
    """The same behind a join: its rows are written once, and cut by the text of a column with many equals."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").select("o_orderkey", "c_mktsegment", "o_orderpriority")
    order = [OrderKey("c_mktsegment"), OrderKey("o_orderpriority", descending=True), OrderKey("o_orderkey")]
    return first_rows(joined, 1200, order, one_task_rows=1000, sampled=2000)


def limit_export_files(spark, folder):
    """A limit over one table reads only the files that hold its rows: the first rows in file order."""
    return first_rows_of_files(table(spark, folder, "events"), 700)


def table_head_query(spark, folder):
    return table_head(table(spark, folder, "customer").orderBy("c_custkey"))


def topk_groups(spark, folder):
    price = F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 4).alias("avg_price")
    return top_groups(table(spark, folder, "orders"), "o_custkey", price, 10)


def pinned_sort_query(spark, folder):
    """How the segments follow each other: where in the sorted rows each begins and ends."""
    customer = table(spark, folder, "customer")
    ordered = pinned_sort(customer, "c_mktsegment", "MACHINERY").select("c_mktsegment", F.monotonically_increasing_id().alias("place"))
    spans = ordered.groupBy("c_mktsegment").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    by_place = Window.orderBy("first")
    return spans.select(
        "c_mktsegment",
        F.row_number().over(by_place).alias("position"),
        F.col("n").alias("customers"),
        F.coalesce(F.col("first") > F.lag("last").over(by_place), F.lit(True)).alias("after_the_one_before"),
    )


QUERIES = {
    "limit_default": limit_default,
    "limit_preview": limit_preview,
    "limit_export": limit_export,
    "limit_export_none": limit_export_none,
    "limit_export_large": limit_export_large,
    "limit_export_cut": limit_export_cut,
    "limit_export_joined_cut": limit_export_joined_cut,
    "limit_export_files": limit_export_files,
    "table_head": table_head_query,
    "topk_groups": topk_groups,
    "pinned_sort": pinned_sort_query,
}

ORDERS_SQL = "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey"

SQL = {
    "limit_default": f"{ORDERS_SQL} LIMIT 100",
    "limit_preview": f"{ORDERS_SQL} LIMIT 25",
    "limit_export": f"{ORDERS_SQL} LIMIT 1200",
    "limit_export_none": "SELECT event_id, event_type FROM events",
    "limit_export_large": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 4321"
    ),
    "limit_export_cut": "SELECT o_orderdate, o_custkey, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 1500",
    "limit_export_joined_cut": (
        "SELECT o_orderkey, c_mktsegment, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
        "ORDER BY c_mktsegment NULLS FIRST, o_orderpriority DESC, o_orderkey LIMIT 1200"
    ),
    "limit_export_files": "SELECT * FROM events ORDER BY event_id LIMIT 700",
    "table_head": "SELECT * FROM customer ORDER BY c_custkey LIMIT 1000",
    "topk_groups": (
        "SELECT o_custkey, round(CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 4) AS avg_price FROM orders "
        "GROUP BY o_custkey ORDER BY avg_price DESC, o_custkey LIMIT 10"
    ),
    "pinned_sort": (
        "SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment <> 'MACHINERY', c_mktsegment) AS INTEGER) AS position, "
        "count(*) AS customers, true AS after_the_one_before FROM customer GROUP BY c_mktsegment"
    ),
}
