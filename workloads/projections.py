"""Column selection and naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rowferry.functions.casting import typed_projection
from rowferry.operators.joins import salted_join
from rowferry.operators.limits import first_rows
from rowferry.operators.profile import candidate_keys
from rowferry.plans import ExportSpec, JoinSpec, compile_export, prepare_export
from workloads.common import EVENT_TYPES, event_text, table, tables


def project_columns(spark, folder):
    """Order kept, blank entries skipped, bare names belong to the main table."""
    spec = ExportSpec("lineitem", ("l_shipdate", " ", "l_orderkey", '"l_linenumber"', ""))
    return compile_export(spec, tables(spark, folder))


def project_qualified(spark, folder):
    spec = ExportSpec(
        "customer",
        ('customer."c_name"', "nation.n_name", "c_custkey"),
        (JoinSpec("nation", "INNER JOIN", "customer.c_nationkey = nation.n_nationkey"),),
    )
    return compile_export(spec, tables(spark, folder))


def project_odd_names(spark, folder):
    """Names with blanks, dots and backticks, in tables and conditions."""
    odd = {
        "my orders": table(spark, folder, "orders").withColumnsRenamed(
            {"o_orderkey": "order key", "o_custkey": "cust`key", "o_totalprice": "total.price"}
        ),
        "my customers": table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "cust`key", "c_name": "full name"}),
    }
    spec = ExportSpec(
        "my orders",
        ("order key", "my orders.total.price", "my customers.full name"),
        (JoinSpec("my customers", "INNER JOIN", pairs=(("cust`key", "cust`key"),)),),
    )
    return compile_export(spec, odd).withColumnsRenamed(
        {"order key": "order_key", "total.price": "total_price", "full name": "full_name"}
    )


def project_duplicates(spark, folder):
    """A name that occurs twice is told apart by its table."""
    renamed = {
        "supplier": table(spark, folder, "supplier").withColumnsRenamed({"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"}),
        "customer": table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "key", "c_name": "name", "c_acctbal": "balance"}),
    }
    spec = ExportSpec(
        "customer",
        ("key", "name", "balance", "supplier.key", "supplier.name", "supplier.nation"),
        (JoinSpec("supplier", "LEFT JOIN", "customer.key = supplier.key"),),
    )
    return compile_export(spec, renamed)


CUSTOMER_KEYS = ("c_custkey", "c_custkey", "c_nationkey", "c_custkey", "c_custkey", "c_custkey")
ORDER_KEYS = ("o_orderkey", "o_custkey", "o_orderkey", "o_custkey", "o_orderkey", "o_custkey")
RESERVED = ("order_0", "key_0", "part", "before", "left_own", "row_count")


def project_reserved_names(spark, folder):
    """Tables whose columns are named like those that joins, limits and sorts add for themselves."""
    customer = table(spark, folder, "customer").select(*[F.col(c).alias(n) for n, c in zip(RESERVED, CUSTOMER_KEYS)])
    orders = table(spark, folder, "orders").select(*[F.col(c).alias(n) for n, c in zip(RESERVED, ORDER_KEYS)])
    known = {"c": customer, "o": orders}

    def ways():
        for kind in ("SEMI", "ANTI"):
            join = JoinSpec("o", f"{kind} JOIN", "c.key_0 = o.key_0")
            yield kind, compile_export(ExportSpec("c", RESERVED, (join,)), known)
        salted = salted_join(customer.alias("c"), orders.alias("o"), [F.col("c.key_0")], [F.col("o.key_0")], "full", hot_key_rows=5)
        yield "SALTED", salted.select(*[F.coalesce(f"c.{n}", f"o.{n}").alias(n) for n in RESERVED])
        yield "LIMIT", first_rows(orders, 50, [F.col("order_0")], one_task_rows=10)
        yield "ORDER", prepare_export(ExportSpec("o", RESERVED, order_by=("key_0", "order_0")), known)

    rows = reduce(lambda a, b: a.union(b), [df.select(F.lit(way).alias("way"), *RESERVED) for way, df in ways()])
    keys = candidate_keys(orders).select(F.concat(F.lit("KEYS "), "column_name"), "row_count", F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.col("is_key").cast("bigint"))
    return rows.union(keys)


def cast_projection(spark, folder):
    """Text to declared types; what does not fit becomes NULL."""
    return typed_projection(event_text(spark, folder), EVENT_TYPES | {"props": "Json"})


QUERIES = {
    "project_reserved_names": project_reserved_names,
    "project_columns": project_columns,
    "project_qualified": project_qualified,
    "project_odd_names": project_odd_names,
    "project_duplicates": project_duplicates,
    "cast_projection": cast_projection,
}

C_ROW = "c_custkey AS order_0, c_custkey AS key_0, CAST(c_nationkey AS BIGINT) AS part, c_custkey AS before, c_custkey AS left_own, c_custkey AS row_count"
O_ROW = "o_orderkey, o_custkey, o_orderkey, o_custkey, o_orderkey, o_custkey"

SQL = {
    "project_reserved_names": (
        f"SELECT 'SEMI' AS way, {C_ROW} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL "
        f"SELECT 'ANTI', {C_ROW} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL "
        f"SELECT 'SALTED', coalesce(c_custkey, o_orderkey), coalesce(c_custkey, o_custkey), coalesce(c_nationkey, o_orderkey), "
        "coalesce(c_custkey, o_custkey), coalesce(c_custkey, o_orderkey), coalesce(c_custkey, o_custkey) "
        "FROM customer FULL JOIN orders ON c_custkey = o_custkey UNION ALL "
        f"(SELECT 'LIMIT', {O_ROW} FROM orders ORDER BY o_orderkey LIMIT 50) UNION ALL "
        f"SELECT 'ORDER', {O_ROW} FROM orders UNION ALL "
        "SELECT 'KEYS ' || name, (SELECT count(*) FROM orders), NULL, NULL, NULL, NULL, "
        "(SELECT CAST(CASE WHEN name IN ('order_0', 'part', 'left_own') THEN count(DISTINCT o_orderkey) = count(*) "
        "ELSE count(DISTINCT o_custkey) = count(*) END AS BIGINT) FROM orders) "
        "FROM (VALUES ('order_0'), ('key_0'), ('part'), ('before'), ('left_own'), ('row_count')) AS names(name)"
    ),
    "project_columns": "SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem",
    "project_qualified": "SELECT c_name, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "project_odd_names": (
        "SELECT o_orderkey AS order_key, o_totalprice AS total_price, c_name AS full_name "
        "FROM orders JOIN customer ON o_custkey = c_custkey"
    ),
    "project_duplicates": (
        "SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS balance, s_suppkey AS supplier_key, "
        "s_name AS supplier_name, s_nationkey AS nation FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"
    ),
    "cast_projection": (
        "SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts, user_id, event_type, "
        "CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events"
    ),
}
