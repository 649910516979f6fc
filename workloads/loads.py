"""Loading files into tables, with bad rows and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.operators.quality import error_budget, reject_rows, validate_types
from rowferry.operators.sets import append_union
from rowferry.plans import LoadSpec
from rowferry.sinks.files import export_delimited
from rowferry.sinks.tables import append_rows, create_table, load_file, load_outcome
from workloads.common import EVENT_TYPES, ORDER_TYPES, event_text, fresh_path, fresh_table, table


def _orders_file(spark, folder):
    path = fresh_path(spark, "load-file")
    export_delimited(table(spark, folder, "orders"), path)
    return path


def create_table_query(spark, folder):
    """Blank names are skipped, blank types are text; a second create changes nothing."""
    name = fresh_table("create")
    types = {"p_partkey": "Int64", " ": "Int32", "p_name": "", "p_size": "UInt32", "p_retailprice": "Float64"}
    create_table(spark, name, types, fresh_path(spark, "create"))
    create_table(spark, name, {"other": "String"})
    append_rows(table(spark, folder, "part"), name)
    return spark.table(name)


def load_all_columns(spark, folder):
    name = fresh_table("all")
    create_table(spark, name, ORDER_TYPES, fresh_path(spark, "all"))
    load_file(spark, _orders_file(spark, folder), LoadSpec(name))
    return spark.table(name)


def load_selected_columns(spark, folder):
    """Only the chosen file columns are loaded; the others become NULL."""
    name = fresh_table("selected")
    create_table(spark, name, ORDER_TYPES, fresh_path(spark, "selected"))
    load_file(spark, _orders_file(spark, folder), LoadSpec(name, columns=("o_orderkey", "o_totalprice")))
    return spark.table(name)


def load_create_or_append(spark, folder):
    """The first load creates the table, the second appends to it."""
    name = fresh_table("create_or_append")
    path = _orders_file(spark, folder)
    spec = LoadSpec(name, create=True, column_types=ORDER_TYPES, location=fresh_path(spark, "create-or-append"))
    load_file(spark, path, spec)
    load_file(spark, path, LoadSpec(name))
    return spark.table(name)


def load_untyped(spark, folder):
    """A new table without types holds text, in file order."""
    name = fresh_table("untyped")
    spec = LoadSpec(name, create=True, location=fresh_path(spark, "untyped"))
    path = fresh_path(spark, "untyped-file")
    export_delimited(table(spark, folder, "part"), path)
    load_file(spark, path, spec)
    return spark.table(name)


def load_inferred(spark, folder):
    """A new table with the types that fit the file, one of them overridden."""
    name = fresh_table("inferred")
    spec = LoadSpec(name, create=True, infer=True, column_types={"o_orderkey": "Int64"}, location=fresh_path(spark, "inferred"))
    load_file(spark, _orders_file(spark, folder), spec)
    return spark.table(name)


def load_summary(spark, folder):
    name = fresh_table("summary")
    spec = LoadSpec(name, create=True, column_types=ORDER_TYPES, location=fresh_path(spark, "summary"))
    return load_file(spark, _orders_file(spark, folder), spec).as_frame(spark)


def rows_loaded(spark, folder):
    """Two loads of the same file, each counted by its own write."""
    name = fresh_table("counted")
    path = _orders_file(spark, folder)
    spec = LoadSpec(name, create=True, column_types=ORDER_TYPES, location=fresh_path(spark, "counted"))
    first, second = load_file(spark, path, spec), load_file(spark, path, spec)
    return spark.table(name).agg(
        F.lit(first.lines).cast("bigint").alias("first_rows"),
        F.lit(second.lines).cast("bigint").alias("second_rows"),
        F.count(F.lit(1)).alias("table_rows"),
    )


def load_with_bad_rows(spark, folder):
    """Bad rows within the budget are left out, the rest is loaded."""
    path = fresh_path(spark, "bad-rows-file")
    export_delimited(event_text(spark, folder), path)
    name = fresh_table("bad_rows")
    spec = LoadSpec(name, create=True, column_types=EVENT_TYPES, max_bad_ratio=0.9, location=fresh_path(spark, "bad-rows"))
    load_file(spark, path, spec)
    return spark.table(name)


def load_rejects(spark, folder):
    """The rows a load left out, kept beside the table."""
    path, kept = fresh_path(spark, "rejects-file"), fresh_path(spark, "rejects")
    export_delimited(event_text(spark, folder), path)
    spec = LoadSpec(fresh_table("rejects"), create=True, column_types=EVENT_TYPES, max_bad_ratio=0.9, location=fresh_path(spark, "kept"))
    load_file(spark, path, spec, rejects=kept)
    return spark.read.parquet(kept)


def load_ragged(spark, folder):
    """Rows with a cell too many or too few are bad rows, counted and kept apart."""
    path, kept = fresh_path(spark, "ragged-file"), fresh_path(spark, "ragged-rejects")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    key, narrow, wide = F.col("o_orderkey"), F.col("o_orderkey") % 10 == 1, F.col("o_orderkey") % 10 == 0
    line = F.concat_ws(",", key.cast("string"), F.when(~narrow, F.col("o_orderstatus")), F.when(wide, F.lit("x")))
    orders.select(line.alias("k,s")).repartition(3).write.options(header="true", sep="\x02", quote="\x01").csv(path)
    name = fresh_table("ragged")
    spec = LoadSpec(name, create=True, column_types={"k": "Int64", "s": "String"}, max_bad_ratio=0.9, location=fresh_path(spark, "ragged"))
    result = load_file(spark, path, spec, rejects=kept)
    good = spark.table(name).select(F.col("k").alias("o_orderkey"), F.lit("loaded").alias("outcome"))
    bad = spark.read.parquet(kept).select(F.col("k").cast("bigint"), F.col("bad_columns"))
    return good.union(bad).withColumn("rejected", F.lit(result.rejected).cast("bigint"))


def load_header_order(spark, folder):
    """Files whose headers name the columns in another order."""
    path = fresh_path(spark, "order-file")
    orders = table(spark, folder, "orders")
    export_delimited(orders.where("o_orderkey % 2 = 0"), path)
    export_delimited(orders.where("o_orderkey % 2 = 1").select(*reversed(orders.columns)), path, mode="append")
    name = fresh_table("order")
    load_file(spark, path, LoadSpec(name, create=True, column_types=ORDER_TYPES, location=fresh_path(spark, "order")))
    return spark.table(name)


def load_missing_column(spark, folder):
    """A declared column that the file lacks is an error; nothing is loaded."""
    name = fresh_table("missing")
    spec = LoadSpec(name, create=True, column_types=ORDER_TYPES | {"o_comment": "String"}, location=fresh_path(spark, "missing"))
    outcome = load_outcome(spark, _orders_file(spark, folder), spec)
    return spark.table(name).agg(F.count("*").alias("rows_loaded")).select(
        F.lit(outcome.success).alias("success"), F.lit(outcome.message).alias("message"), "rows_loaded"
    )


def reject_rows_query(spark, folder):
    return reject_rows(event_text(spark, folder), EVENT_TYPES)


def error_budget_query(spark, folder):
    return error_budget(event_text(spark, folder), EVENT_TYPES)


def validate_types_query(spark, folder):
    return validate_types(event_text(spark, folder), EVENT_TYPES)


def append_union_query(spark, folder):
    """Suppliers and customers by column name: unknown columns go, absent ones are NULL."""
    supplier = table(spark, folder, "supplier").withColumnsRenamed({"s_suppkey": "key", "s_name": "name", "s_acctbal": "balance"})
    customer = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "key", "c_name": "name"})
    return append_union(supplier, customer)


QUERIES = {
    "create_table": create_table_query,
    "load_all_columns": load_all_columns,
    "load_selected_columns": load_selected_columns,
    "load_create_or_append": load_create_or_append,
    "load_untyped": load_untyped,
    "load_inferred": load_inferred,
    "load_summary": load_summary,
    "rows_loaded": rows_loaded,
    "load_with_bad_rows": load_with_bad_rows,
    "load_rejects": load_rejects,
    "load_ragged": load_ragged,
    "load_header_order": load_header_order,
    "load_missing_column": load_missing_column,
    "reject_rows": reject_rows_query,
    "error_budget": error_budget_query,
    "validate_types": validate_types_query,
    "append_union": append_union_query,
}

REJECTS_SQL = (
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS user_id, "
    "event_type, 'n/a' AS value, props, 'ts,value' AS bad_columns FROM events WHERE event_type = 'error'"
)

SQL = {
    "create_table": "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "load_all_columns": "SELECT * FROM orders",
    "load_selected_columns": (
        "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice, "
        "CAST(NULL AS TIMESTAMP) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders"
    ),
    "load_create_or_append": "SELECT * FROM orders UNION ALL SELECT * FROM orders",
    "load_untyped": (
        "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, "
        "CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part"
    ),
    "load_inferred": (
        "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
    ),
    "load_summary": "SELECT count(*) AS lines, true AS success, 'Upload successful' AS message FROM orders",
    "rows_loaded": "SELECT count(*) AS first_rows, count(*) AS second_rows, 2 * count(*) AS table_rows FROM orders",
    "load_with_bad_rows": "SELECT * FROM events WHERE event_type <> 'error'",
    "load_rejects": REJECTS_SQL,
    "load_ragged": (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <= 1 THEN '(width)' ELSE 'loaded' END AS outcome, "
        "(SELECT count(*) FROM orders WHERE o_orderkey % 10 <= 1) AS rejected FROM orders"
    ),
    "load_header_order": "SELECT * FROM orders",
    "load_missing_column": "SELECT false AS success, 'Error: the file has no column o_comment' AS message, CAST(0 AS BIGINT) AS rows_loaded",
    "reject_rows": REJECTS_SQL,
    "error_budget": (
        "SELECT count(*) AS row_count, count(*) FILTER (WHERE event_type = 'error') AS bad_count, "
        "NOT (count(*) FILTER (WHERE event_type = 'error') > 10 "
        "AND count(*) FILTER (WHERE event_type = 'error') > count(*) * 0.01) AS within_budget FROM events"
    ),
    "validate_types": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS type_name, count({c}) AS value_count, "
        + ("count(*) FILTER (WHERE event_type = 'error')" if c in ("ts", "value") else "CAST(0 AS BIGINT)")
        + " AS bad_count FROM events"
        for c, t in EVENT_TYPES.items()
    ),
    "append_union": (
        "SELECT s_suppkey AS key, s_name AS name, s_nationkey, s_acctbal AS balance FROM supplier UNION ALL "
        "SELECT c_custkey, c_name, NULL, NULL FROM customer"
    ),
}
