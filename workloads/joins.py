"""Every join kind of an export spec."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.operators.joins import array_join, salted_join, tracked_join
from rowferry.plans import ExportSpec, JoinSpec, compile_export
from workloads.common import table, tables

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice")
ON_CUSTOMER = "orders.o_custkey = customer.c_custkey"


def join_query(spec):
    return lambda spark, folder: compile_export(spec, tables(spark, folder))


def customer_join(kind, condition=ON_CUSTOMER):
    return ExportSpec("orders", (*ORDER_COLUMNS, "customer.c_custkey", "customer.c_name"), (JoinSpec("customer", kind, condition),))


SPECS = {
    "join_inner": customer_join("INNER JOIN"),
    "join_left": customer_join("LEFT JOIN"),
    "join_default": customer_join(None),
    "join_right": customer_join("RIGHT JOIN"),
    "join_full": customer_join("FULL JOIN"),
    "join_outer": customer_join("OUTER JOIN"),
    "join_cross": ExportSpec("customer", ("c_custkey", "region.r_regionkey", "region.r_name"), (JoinSpec("region", "CROSS JOIN"),)),
    "join_blank_condition": ExportSpec("supplier", ("s_suppkey", "region.r_name"), (JoinSpec("region", "LEFT JOIN", " "),)),
    "join_semi": ExportSpec("customer", ("c_custkey", "c_name"), (JoinSpec("orders", "SEMI JOIN", "customer.c_custkey = orders.o_custkey"),)),
    "join_anti": ExportSpec("customer", ("c_custkey", "c_name"), (JoinSpec("orders", "ANTI JOIN", "customer.c_custkey = orders.o_custkey"),)),
    "join_anti_rows": ExportSpec(
        "customer",
        ("c_custkey", "c_name"),
        (JoinSpec("supplier", "ANTI JOIN", "customer.c_custkey = supplier.s_suppkey"),),
    ),
    "join_any": ExportSpec(
        "customer",
        ("c_custkey", "orders.o_orderkey", "orders.o_orderdate", "orders.o_totalprice"),
        (JoinSpec("orders", "ANY JOIN", "customer.c_custkey = orders.o_custkey", order_by=("o_orderdate", "o_orderkey")),),
    ),
    "join_global": ExportSpec(
        "customer", ("c_custkey", "c_name", "nation.n_name"), (JoinSpec("nation", "GLOBAL JOIN", "customer.c_nationkey = nation.n_nationkey"),)
    ),
    "join_global_left": ExportSpec(
        "customer",
        ("c_custkey", "supplier.s_name"),
        (JoinSpec("supplier", "GLOBAL LEFT JOIN", "customer.c_custkey = supplier.s_suppkey"),),
    ),
    "join_any_left": ExportSpec(
        "supplier",
        ("s_suppkey", "lineitem.l_orderkey", "lineitem.l_partkey"),
        (
            JoinSpec(
                "lineitem",
                "LEFT ANY JOIN",
                "supplier.s_suppkey = lineitem.l_suppkey",
                order_by=("l_shipdate", "l_orderkey", "l_partkey"),
            ),
        ),
    ),
    "join_chain": ExportSpec(
        "lineitem",
        ("l_orderkey", "l_linenumber", "orders.o_orderstatus", "customer.c_name", "nation.n_name", "region.r_name"),
        (
            JoinSpec("orders", "INNER JOIN", "lineitem.l_orderkey = orders.o_orderkey"),
            JoinSpec("", "INNER JOIN", "skipped"),
            JoinSpec("customer", "LEFT JOIN", ON_CUSTOMER),
            JoinSpec("nation", "LEFT JOIN", "customer.c_nationkey = nation.n_nationkey"),
            JoinSpec("region", "LEFT JOIN", "nation.n_regionkey = region.r_regionkey"),
        ),
    ),
    "join_multi_key": ExportSpec(
        "customer",
        ("c_custkey", "c_nationkey", "supplier.s_suppkey", "supplier.s_name"),
        (JoinSpec("supplier", "LEFT JOIN", "customer.c_custkey = supplier.s_suppkey AND supplier.s_nationkey = customer.c_nationkey"),),
    ),
    "join_theta": ExportSpec(
        "orders",
        ("o_orderkey", "o_orderdate", "lineitem.l_linenumber", "lineitem.l_shipdate"),
        (JoinSpec("lineitem", "INNER JOIN", "(orders.o_orderkey = lineitem.l_orderkey AND lineitem.l_shipdate > orders.o_orderdate)"),),
    ),
    "join_inequality": ExportSpec(
        "customer",
        ("c_custkey", "c_nationkey", "region.r_regionkey"),
        (JoinSpec("region", "LEFT JOIN", "customer.c_nationkey < region.r_regionkey * 4"),),
    ),
    "join_pairs": ExportSpec(
        "orders", (*ORDER_COLUMNS, "customer.c_name"), (JoinSpec("customer", "INNER JOIN", pairs=(("o_custkey", "c_custkey"),)),)
    ),
    "join_pairs_reversed": ExportSpec(
        "orders", (*ORDER_COLUMNS, "customer.c_name"), (JoinSpec("customer", "INNER JOIN", "customer.c_custkey = orders.o_custkey"),)
    ),
    "join_array": ExportSpec(
        "embeddings", ("vec_id", "embedding_index", "embedding_item"), (JoinSpec("embeddings", "ARRAY JOIN", array_column="embedding"),)
    ),
}


def array_join_query(spark, folder):
    df = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return array_join(df, F.col("embedding"), "item", position="index").select("vec_id", "index", F.col("item").cast("double").alias("item"))


def _large_items(spark, folder):
    df = table(spark, folder, "embeddings")
    return df.select("vec_id", F.filter("embedding", lambda x: x > 0.2).alias("large"))


def array_join_inner(spark, folder):
    return array_join(_large_items(spark, folder), F.col("large"), "item").select("vec_id", F.col("item").cast("double").alias("item"))


def array_join_left(spark, folder):
    """Vectors without a large item keep one row."""
    unfolded = array_join(_large_items(spark, folder), F.col("large"), "item", keep_empty=True)
    return unfolded.select("vec_id", F.col("item").cast("double").alias("item"))


def join_left_hot(spark, folder):
    """The repeated side is hot: each nation against its customers."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    joined = salted_join(nation, customer, [nation["n_nationkey"]], [customer["c_nationkey"]], "left", hot_key_rows=10)
    return joined.select("n_nationkey", "n_name", "c_custkey", "c_name")


def join_full_hot(spark, folder):
    """Users and their events, users without events and events without users."""
    customer, events = table(spark, folder, "customer"), table(spark, folder, "events")
    joined = salted_join(customer, events, [customer["c_custkey"]], [events["user_id"]], "full", hot_key_rows=5)
    return joined.select("c_custkey", "c_name", "event_id", "user_id")


def _later_lines(spark, folder, how):
    """Orders and those of their lines that shipped much later, frequent orders balanced."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    on = (orders["o_orderkey"] == lines["l_orderkey"]) & (lines["l_shipdate"] > orders["o_orderdate"])
    return tracked_join(orders, lines, on, [orders["o_orderkey"]], [lines["l_orderkey"]], how, hot_key_rows=4)


def join_left_condition_hot(spark, folder):
    joined = _later_lines(spark, folder, "left")
    return joined.select("o_orderkey", "o_orderdate", "l_linenumber", "l_partkey", "l_shipdate")


def join_anti_condition_hot(spark, folder):
    return _later_lines(spark, folder, "left_anti").select("o_orderkey", "o_orderdate")


def join_any_odd_names(spark, folder):
    """ANY joins on names with blanks, without a table, with AND in a literal beside them."""
    odd = {
        "c": table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "cust key"}),
        "o": table(spark, folder, "orders").withColumnsRenamed({"o_custkey": "cust of", "o_orderkey": "order"}),
    }
    quoted = JoinSpec("o", "ANY LEFT JOIN", "c.`cust key` = o.`cust of`", order_by=("o_orderdate", "order"))
    bare = JoinSpec("o", "ANY JOIN", "(`cust key` = `cust of`)", order_by=("o_orderdate", "order"))
    kept = ("cust key", "o.order")
    left = compile_export(ExportSpec("c", kept, (quoted,)), odd).select(F.lit("left").alias("way"), F.col("cust key").alias("c"), F.col("order").alias("o"))
    inner = compile_export(ExportSpec("c", kept, (bare,)), odd).select(F.lit("inner"), "cust key", "order")
    return left.union(inner)


def join_right_hot(spark, folder):
    events, customer = table(spark, folder, "events"), table(spark, folder, "customer")
    joined = salted_join(events, customer, [events["user_id"]], [customer["c_custkey"]], "right", hot_key_rows=5)
    return joined.select("c_custkey", "c_name", "event_id", "user_id")


QUERIES = {name: join_query(spec) for name, spec in SPECS.items()} | {
    "array_join": array_join_query,
    "array_join_inner": array_join_inner,
    "array_join_left": array_join_left,
    "join_left_hot": join_left_hot,
    "join_left_condition_hot": join_left_condition_hot,
    "join_anti_condition_hot": join_anti_condition_hot,
    "join_right_hot": join_right_hot,
    "join_any_odd_names": join_any_odd_names,
    "join_full_hot": join_full_hot,
}


def _customer_sql(kind):
    return f"SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM orders {kind} JOIN customer ON o_custkey = c_custkey"


PAIRS_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey"

SQL = {
    "join_inner": _customer_sql("INNER"),
    "join_left": _customer_sql("LEFT"),
    "join_default": _customer_sql("LEFT"),
    "join_right": _customer_sql("RIGHT"),
    "join_full": _customer_sql("FULL"),
    "join_outer": _customer_sql("FULL"),
    "join_cross": "SELECT c_custkey, r_regionkey, r_name FROM customer CROSS JOIN region",
    "join_blank_condition": "SELECT s_suppkey, r_name FROM supplier LEFT JOIN region ON 1 = 1",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "join_any": (
        "SELECT c_custkey, o_orderkey, o_orderdate, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER "
        "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pick FROM orders) o ON c_custkey = o_custkey WHERE pick = 1"
    ),
    "join_any_odd_names": (
        "WITH picked AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pick FROM orders) "
        "SELECT 'left' AS way, c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN picked ON c_custkey = o_custkey AND pick = 1 "
        "UNION ALL SELECT 'inner', c_custkey, o_orderkey FROM customer JOIN picked ON c_custkey = o_custkey AND pick = 1"
    ),
    "join_global": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_global_left": "SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    "join_any_left": (
        "SELECT s_suppkey, l_orderkey, l_partkey FROM supplier LEFT JOIN (SELECT *, row_number() OVER "
        "(PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey) AS pick FROM lineitem) l "
        "ON s_suppkey = l_suppkey AND pick = 1"
    ),
    "join_chain": (
        "SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name, r_name FROM lineitem "
        "JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey "
        "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
    ),
    "join_multi_key": (
        "SELECT c_custkey, c_nationkey, s_suppkey, s_name FROM customer "
        "LEFT JOIN supplier ON c_custkey = s_suppkey AND s_nationkey = c_nationkey"
    ),
    "join_theta": (
        "SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders "
        "JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate"
    ),
    "join_inequality": "SELECT c_custkey, c_nationkey, r_regionkey FROM customer LEFT JOIN region ON c_nationkey < r_regionkey * 4",
    "join_pairs": PAIRS_SQL,
    "join_pairs_reversed": PAIRS_SQL,
    "join_array": (
        "SELECT vec_id, CAST(i - 1 AS INTEGER) AS embedding_index, embedding[i] AS embedding_item FROM "
        "(SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
    ),
    "array_join": (
        'SELECT vec_id, CAST(i - 1 AS INTEGER) AS "index", CAST(embedding[i] AS DOUBLE) AS item FROM '
        "(SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
    ),
    "array_join_inner": (
        "SELECT vec_id, CAST(item AS DOUBLE) AS item FROM (SELECT vec_id, unnest(embedding) AS item FROM embeddings) "
        "WHERE CAST(item AS DOUBLE) > 0.2"
    ),
    "array_join_left": (
        "SELECT e.vec_id, CAST(x.item AS DOUBLE) AS item FROM embeddings e LEFT JOIN "
        "(SELECT vec_id, item FROM (SELECT vec_id, unnest(embedding) AS item FROM embeddings) "
        "WHERE CAST(item AS DOUBLE) > 0.2) x ON e.vec_id = x.vec_id"
    ),
    "join_left_hot": "SELECT n_nationkey, n_name, c_custkey, c_name FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey",
    "join_left_condition_hot": (
        "SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey, l_shipdate FROM orders "
        "LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate"
    ),
    "join_anti_condition_hot": (
        "SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS "
        "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)"
    ),
    "join_right_hot": "SELECT c_custkey, c_name, event_id, user_id FROM events RIGHT JOIN customer ON user_id = c_custkey",
    "join_full_hot": "SELECT c_custkey, c_name, event_id, user_id FROM customer FULL JOIN events ON c_custkey = user_id",
}
