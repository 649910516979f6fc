"""File loads in batches."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowferry.operators.quality import ErrorBudget
from rowferry.sinks.files import export_delimited
from rowferry.streaming.load import loaded_rows, progress_rows, stream_load
from workloads.common import DOCUMENT_TYPES, EVENT_TYPES, ORDER_TYPES, event_text, fresh_path, table, text


# Bytes of text that one arriving file holds at most, about.
FILE_BYTES = 128 << 20


def _file_count(rows, least):
    """Files for the rows' text, each of which one task writes: a few of a small table, more of a larger one."""
    size = sum(F.coalesce(F.octet_length(text(c)), F.lit(0)) for c in rows.columns)
    return max(least, -(-(rows.agg(F.sum(size)).first()[0] or 0) // FILE_BYTES))


def _orders_folder(spark, folder, label):
    """The orders as several files, as they would arrive."""
    path = fresh_path(spark, label)
    export_delimited(table(spark, folder, "orders").repartition(6, "o_orderkey"), f"{path}/in")
    return path


def stream_load_query(spark, folder):
    path = _orders_folder(spark, folder, "stream")
    stream_load(spark, f"{path}/in", ORDER_TYPES, f"{path}/out", f"{path}/state", files_per_batch=2)
    return loaded_rows(spark, f"{path}/out")


def stream_by_header(spark, folder):
    """Columns go by their names: files in another order, and only some of the columns."""
    path = fresh_path(spark, "by-header")
    orders = table(spark, folder, "orders")
    export_delimited(orders.where("o_orderkey % 2 = 0").select(*reversed(orders.columns)), f"{path}/in")
    export_delimited(orders.where("o_orderkey % 2 = 1"), f"{path}/in", mode="append")
    types = {c: ORDER_TYPES[c] for c in ("o_totalprice", "o_orderkey", "o_orderdate")}
    stream_load(spark, f"{path}/in", types, f"{path}/out", f"{path}/state", files_per_batch=3)
    return loaded_rows(spark, f"{path}/out")


def stream_spanning(spark, folder):
    """Cells over line ends."""
    path = fresh_path(spark, "stream-spanning")
    documents = table(spark, folder, "documents")
    export_delimited(documents.repartition(_file_count(documents, 4), "doc_id"), f"{path}/in")
    stream_load(spark, f"{path}/in", DOCUMENT_TYPES, f"{path}/out", f"{path}/state", files_per_batch=2)
    return loaded_rows(spark, f"{path}/out")


def stream_budget(spark, folder):
    """A batch over its budget writes nothing and fails the load; the one before it stays."""
    path = fresh_path(spark, "stream-budget")
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("string"))
    types = {"o_orderkey": "Int64", "o_totalprice": "Float64"}
    export_delimited(orders.where("o_orderkey % 2 = 0"), f"{path}/in")
    stream_load(spark, f"{path}/in", types, f"{path}/out", f"{path}/state")
    export_delimited(orders.where("o_orderkey % 2 = 1").withColumn("o_totalprice", F.lit("n/a")), f"{path}/in", mode="append")
    try:
        stream_load(spark, f"{path}/in", types, f"{path}/out", f"{path}/state")
        failed = False
    except StreamingQueryException:
        failed = True
    return loaded_rows(spark, f"{path}/out").withColumn("next_failed", F.lit(failed))


def stream_resume(spark, folder):
    """Finished orders arrive first, the others later; a rerun loads only the new files."""
    path = fresh_path(spark, "resume")
    orders = table(spark, folder, "orders")
    for arrival in (orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")):
        export_delimited(arrival, f"{path}/in", mode="append")
        stream_load(spark, f"{path}/in", ORDER_TYPES, f"{path}/out", f"{path}/state")
    return loaded_rows(spark, f"{path}/out")


def stream_rejects(spark, folder):
    """Good rows and bad rows of a stream, each in its place: counted together."""
    path = fresh_path(spark, "stream-rejects")
    export_delimited(event_text(spark, folder), f"{path}/in")
    stream_load(spark, f"{path}/in", EVENT_TYPES, f"{path}/out", f"{path}/state", rejects=f"{path}/bad", budget=ErrorBudget(max_ratio=0.9))
    good = loaded_rows(spark, f"{path}/out").select(F.lit("loaded").alias("outcome"), "event_id")
    bad = loaded_rows(spark, f"{path}/bad").select(F.lit("rejected").alias("outcome"), F.col("event_id").cast("bigint"))
    return good.union(bad)


def stream_progress(spark, folder):
    path = _orders_folder(spark, folder, "progress")
    stream_load(spark, f"{path}/in", ORDER_TYPES, f"{path}/out", f"{path}/state", files_per_batch=2)
    steps = progress_rows(spark, f"{path}/state")
    return steps.agg(
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_loaded").alias("rows_loaded"),
        F.max("rows_so_far").alias("rows_so_far"),
        F.max("bytes_so_far").alias("bytes_so_far"),
    )


QUERIES = {
    "stream_load": stream_load_query,
    "stream_by_header": stream_by_header,
    "stream_spanning": stream_spanning,
    "stream_budget": stream_budget,
    "stream_resume": stream_resume,
    "stream_rejects": stream_rejects,
    "stream_progress": stream_progress,
}

SQL = {
    "stream_load": "SELECT * FROM orders",
    "stream_by_header": "SELECT o_totalprice, o_orderkey, o_orderdate FROM orders",
    "stream_spanning": "SELECT * FROM documents",
    "stream_budget": (
        "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) > 10 AS next_failed "
        "FROM orders WHERE o_orderkey % 2 = 0"
    ),
    "stream_resume": "SELECT * FROM orders",
    "stream_rejects": "SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'loaded' END AS outcome, event_id FROM events",
    "stream_progress": (
        "SELECT count(*) AS rows_read, count(*) AS rows_loaded, count(*) AS rows_so_far, CAST(sum("
        + " + ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)), 0)" for c in ORDER_TYPES)
        # Five commas and a line end a row; six files, each with its header.
        + f" + 6) + 6 * (strlen('{','.join(ORDER_TYPES)}') + 1) AS BIGINT) AS bytes_so_far FROM orders"
    ),
}
