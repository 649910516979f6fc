"""Table access shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.functions.text import iso_text
from rowferry.session import scratch_path

# Declared types of tables that are written as text and read back.
ORDER_TYPES = {
    "o_orderkey": "Int64",
    "o_custkey": "Int64",
    "o_orderstatus": "String",
    "o_totalprice": "Float64",
    "o_orderdate": "DateTime",
    "o_orderpriority": "String",
}
LINE_TYPES = {
    "l_orderkey": "Int64",
    "l_partkey": "Int64",
    "l_suppkey": "Int64",
    "l_linenumber": "Int32",
    "l_quantity": "Float64",
    "l_extendedprice": "Float64",
    "l_discount": "Float64",
    "l_tax": "Float64",
    "l_returnflag": "String",
    "l_linestatus": "String",
    "l_shipdate": "DateTime",
}
EVENT_TYPES = {
    "event_id": "Int64",
    "ts": "DateTime",
    "user_id": "Int64",
    "event_type": "String",
    "value": "Float64",
    "props": "String",
}
DOCUMENT_TYPES = {
    "doc_id": "Int64",
    "text": "String",
    "lang": "String",
    "source": "String",
    "n_chars": "Int64",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str):
    """Name -> DataFrame, as the export specs look tables up."""
    return lambda name: table(spark, folder, name)


def fresh_path(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def fresh_table(label: str) -> str:
    return f"rowferry_{label}_{uuid.uuid4().hex}"


def text(column: str) -> Column:
    return F.col(column).cast("string")


def event_text(spark: SparkSession, folder: str) -> DataFrame:
    """Events as text, with faults: errors have no number, their time is not ISO."""
    events = table(spark, folder, "events")
    is_error = F.col("event_type") == "error"
    return events.select(
        text("event_id").alias("event_id"),
        F.when(is_error, text("ts")).otherwise(iso_text(F.col("ts"))).alias("ts"),
        text("user_id").alias("user_id"),
        F.col("event_type"),
        F.when(is_error, F.lit("n/a")).otherwise(text("value")).alias("value"),
        F.col("props"),
    )
