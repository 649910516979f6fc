"""Sinks: files in several formats, each read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.functions.casting import typed_projection
from rowferry.plans import ExportSpec, JoinSpec, prepare_export
from rowferry.sinks.files import export_delimited, export_format, export_name, export_quoted, run_export
from rowferry.sources.delimited import read_delimited
from workloads.common import EVENT_TYPES, LINE_TYPES, ORDER_TYPES, fresh_path, table, tables

ORDERS_WITH_NAMES = ExportSpec(
    table="orders",
    columns=("o_orderkey", "o_totalprice", "customer.c_name"),
    joins=(JoinSpec("customer", "LEFT JOIN", "orders.o_custkey = customer.c_custkey"),),
    delimiter="|",
)

THREE_TABLES = ExportSpec(
    table="lineitem",
    columns=("l_orderkey", "l_linenumber", "l_extendedprice", "orders.o_orderdate", "customer.c_name"),
    joins=(
        JoinSpec("orders", "INNER JOIN", "lineitem.l_orderkey = orders.o_orderkey"),
        JoinSpec("customer", "LEFT JOIN", "orders.o_custkey = customer.c_custkey"),
    ),
)


def export_roundtrip(spark, folder):
    """Join, project, write delimited, read back, convert."""
    spec = ORDERS_WITH_NAMES
    path, _ = run_export(spec, tables(spark, folder), fresh_path(spark, "roundtrip"))
    text = read_delimited(spark, path, spec.separator)
    return typed_projection(text, {"o_orderkey": "Int64", "o_totalprice": "Float64", "c_name": "String"})


def export_three_tables(spark, folder):
    path = fresh_path(spark, "three-tables")
    export_delimited(prepare_export(THREE_TABLES, tables(spark, folder)), path)
    return typed_projection(
        read_delimited(spark, path),
        {"l_orderkey": "Int64", "l_linenumber": "Int32", "l_extendedprice": "Float64",
         "o_orderdate": "DateTime", "c_name": "String"},
    )


def export_csv(spark, folder):
    path = f"{fresh_path(spark, 'csv')}/{export_name('events')}"
    export_delimited(table(spark, folder, "events"), path, compression="gzip")
    return typed_projection(read_delimited(spark, path), EVENT_TYPES)


def export_pipe(spark, folder):
    path = fresh_path(spark, "pipe")
    export_delimited(table(spark, folder, "orders"), path, "|")
    return typed_projection(read_delimited(spark, path, "|"), ORDER_TYPES)


def export_quoted_query(spark, folder):
    path = f"{fresh_path(spark, 'quoted')}/nested/folder"
    export_quoted(table(spark, folder, "conversations"), path)
    return typed_projection(
        read_delimited(spark, path), {"conv_id": "Int64", "turn": "Int64", "role": "String", "text": "String"}
    )


def export_json(spark, folder):
    path = fresh_path(spark, "json")
    export_format(table(spark, folder, "customer"), path, "JSON")
    return spark.read.schema(table(spark, folder, "customer").schema).json(path)


def _fine_times(spark, folder):
    """Events with microseconds, as a time without a zone and as one with it."""
    ts = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 1000000 / 1000000).cast("decimal(18,6)"))
    return table(spark, folder, "events").withColumns({"ts": ts, "zoned": ts.cast("timestamp")})


def export_times_csv(spark, folder):
    """All microseconds come back, also of times with a zone (the session's, not written)."""
    path = fresh_path(spark, "times-csv")
    export_delimited(_fine_times(spark, folder), path)
    return typed_projection(read_delimited(spark, path), EVENT_TYPES | {"zoned": "DateTime"})


def export_times_json(spark, folder):
    path = fresh_path(spark, "times-json")
    export_format(_fine_times(spark, folder), path, "JSON")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _fine_times(spark, folder).schema.fields)
    back = spark.read.schema(schema).json(path)
    return back.withColumn("zoned", F.col("zoned").cast("timestamp_ntz"))


def export_nulls(spark, folder):
    """Rows of nothing but NULL survive, in a file of tabs and in one of a single column."""
    events = table(spark, folder, "events")
    gone = F.col("event_type") == "error"
    wide, narrow = fresh_path(spark, "nulls-wide"), fresh_path(spark, "nulls-narrow")
    export_delimited(events.select(*[F.when(~gone, F.col(c)).alias(c) for c in ("event_id", "event_type")]), wide, "tab")
    export_delimited(events.select(F.when(~gone, F.col("event_type")).alias("event_type")), narrow)
    back = typed_projection(read_delimited(spark, wide, "tab"), {"event_id": "Int64", "event_type": "String"})
    only = read_delimited(spark, narrow).select(F.lit(None).cast("bigint").alias("event_id"), "event_type")
    return back.withColumn("columns", F.lit(2)).unionByName(only.withColumn("columns", F.lit(1)))


def export_twice(spark, folder):
    """A column chosen twice is numbered."""
    spec = ExportSpec("nation", ("n_nationkey", "n_name", "n_nationkey"))
    path = fresh_path(spark, "twice")
    export_delimited(prepare_export(spec, tables(spark, folder)), path)
    return typed_projection(
        read_delimited(spark, path), {"nation_n_nationkey": "Int64", "n_name": "String", "nation_n_nationkey_2": "Int64"}
    )


def export_parquet(spark, folder):
    path = fresh_path(spark, "parquet")
    export_format(table(spark, folder, "lineitem"), path, "Parquet")
    return spark.read.parquet(path)


def export_orc(spark, folder):
    path = fresh_path(spark, "orc")
    export_format(table(spark, folder, "part"), path, "ORC")
    return spark.read.orc(path)


def export_unknown_format(spark, folder):
    """An unknown format name falls back to delimited text with a header."""
    path = fresh_path(spark, "unknown")
    export_format(table(spark, folder, "orders"), path, "NoSuchFormat")
    return typed_projection(read_delimited(spark, path), ORDER_TYPES)


def export_count(spark, folder):
    """Rows counted by the write itself, against the file that was written."""
    path = fresh_path(spark, "count")
    written = export_delimited(table(spark, folder, "lineitem"), path, "|")
    back = read_delimited(spark, path, "|", columns=list(LINE_TYPES))
    return back.agg(F.lit(written).cast("bigint").alias("rows_written"), F.count(F.lit(1)).alias("rows_read"))


QUERIES = {
    "export_roundtrip": export_roundtrip,
    "export_three_tables": export_three_tables,
    "export_csv": export_csv,
    "export_pipe": export_pipe,
    "export_quoted": export_quoted_query,
    "export_json": export_json,
    "export_times_csv": export_times_csv,
    "export_times_json": export_times_json,
    "export_nulls": export_nulls,
    "export_twice": export_twice,
    "export_parquet": export_parquet,
    "export_orc": export_orc,
    "export_unknown_format": export_unknown_format,
    "export_count": export_count,
}

FINE = "ts + to_microseconds(CAST(event_id % 1000000 AS BIGINT))"

SQL = {
    "export_times_csv": f"SELECT * REPLACE ({FINE} AS ts), {FINE} AS zoned FROM events",
    "export_times_json": f"SELECT * REPLACE ({FINE} AS ts), {FINE} AS zoned FROM events",
    "export_nulls": (
        "SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id, "
        "CASE WHEN event_type <> 'error' THEN event_type END AS event_type, 2 AS columns FROM events UNION ALL "
        "SELECT NULL, CASE WHEN event_type <> 'error' THEN event_type END, 1 FROM events"
    ),
    "export_twice": "SELECT n_nationkey AS nation_n_nationkey, n_name, n_nationkey AS nation_n_nationkey_2 FROM nation",
    "export_roundtrip": (
        "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
    ),
    "export_three_tables": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderdate, c_name FROM lineitem "
        "JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"
    ),
    "export_csv": "SELECT * FROM events",
    "export_pipe": "SELECT * FROM orders",
    "export_quoted": "SELECT * FROM conversations",
    "export_json": "SELECT * FROM customer",
    "export_parquet": "SELECT * FROM lineitem",
    "export_orc": "SELECT * FROM part",
    "export_unknown_format": "SELECT * FROM orders",
    "export_count": "SELECT count(*) AS rows_written, count(*) AS rows_read FROM lineitem",
}
