"""Scalar functions over texts derived from the tables.

Each cast runs on every row in accepted and refused spellings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.functions.casting import cast_text
from rowferry.functions.text import iso_text, parse_datetime, safe_name, unquote
from workloads.common import table, text


def cast_int(spark, folder):
    key = text("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        cast_text(key, "Int32").alias("plain"),
        cast_text(F.concat(F.lit("-"), key), "Int32").alias("negative"),
        cast_text(F.concat(F.lit("+"), key), "Int32").alias("signed"),
        cast_text(F.concat(F.lit(" "), key), "Int32").alias("padded"),
        cast_text(F.concat(key, F.lit("000000")), "Int32").alias("large"),
        cast_text(text("o_totalprice"), "Int32").alias("decimals"),
        cast_text(F.concat(F.lit("1,"), key), "Int32").alias("commas"),
        cast_text(F.col("o_orderstatus"), "Int32").alias("word"),
        cast_text(F.lit(""), "Int32").alias("empty"),
    )


def cast_bigint(spark, folder):
    key = text("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        cast_text(F.concat(key, F.lit("000000")), "Int64").alias("large"),
        cast_text(F.concat(key, F.lit("000000000000000")), "Int64").alias("huge"),
        cast_text(F.concat(key, F.lit(".5")), "Int64").alias("decimals"),
        cast_text(F.concat(key, F.lit(" ")), "Int64").alias("padded"),
        cast_text(key, "UInt16").alias("unsigned"),
        cast_text(F.concat(F.lit("-"), key), "UInt32").alias("unsigned_negative"),
    )


def cast_double(spark, folder):
    price = text("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        cast_text(price, "Float64").alias("plain"),
        cast_text(F.concat(F.lit(" "), text("o_orderkey"), F.lit("e2 ")), "Float64").alias("exponent"),
        cast_text(F.concat(F.lit("1,"), price), "Float64").alias("commas"),
        cast_text(F.col("o_orderpriority"), "Float64").alias("words"),
        cast_text(F.when(F.col("o_orderstatus") == "F", "inf").otherwise("nan"), "Float64").alias("short_words"),
        cast_text(price, "Decimal(12, 2)").alias("exact"),
    )


def cast_date(spark, folder):
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        cast_text(day, "Date").alias("plain"),
        cast_text(F.date_format("o_orderdate", "MM/dd/yyyy"), "Date").alias("slashes"),
        cast_text(F.date_format("o_orderdate", "yyyy-MM"), "Date").alias("month_only"),
        cast_text(F.date_format("o_orderdate", "yyyy-dd-MM"), "Date").alias("swapped"),
        cast_text(F.date_format("o_orderdate", "yyyy-MM-'31'"), "Date").alias("day_31"),
        cast_text(iso_text(F.col("o_orderdate")), "Date").alias("with_time"),
    )


def cast_datetime(spark, folder):
    moment = iso_text(F.col("ts"))
    return table(spark, folder, "events").select(
        "event_id",
        cast_text(moment, "DateTime").alias("plain"),
        cast_text(F.lower(moment), "DateTime").alias("lower_case"),
        cast_text(F.substring(moment, 1, 16), "DateTime").alias("minutes"),
        cast_text(text("ts"), "DateTime").alias("blank_between"),
        cast_text(F.substring(moment, 1, 10), "DateTime").alias("date_only"),
        cast_text(F.concat(moment, F.lit("Z")), "DateTime").alias("with_zone"),
        cast_text(F.concat(F.substring(moment, 1, 11), F.lit("25"), F.substring(moment, 14, 6)), "DateTime").alias("hour_25"),
    )


def cast_bool(spark, folder):
    quality, toxic = F.col("quality"), F.col("toxic")
    return table(spark, folder, "labels").select(
        "doc_id",
        cast_text(quality.cast("string"), "Bool").alias("digit"),
        cast_text(F.when(quality == 1, "Yes").otherwise("NO"), "Bool").alias("yes_no"),
        cast_text(F.when(toxic == 1, "TRUE").otherwise("False"), "Bool").alias("true_false"),
        cast_text(F.when(toxic == 1, "t").otherwise("f"), "Bool").alias("letter"),
        cast_text(text("doc_id"), "Bool").alias("number"),
    )


def cast_uuid(spark, folder):
    digest = F.md5(text("event_id"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return table(spark, folder, "events").select(
        "event_id",
        cast_text(uuid, "UUID").alias("plain"),
        cast_text(F.upper(uuid), "UUID").alias("upper_case"),
        cast_text(digest, "UUID").alias("no_hyphens"),
        cast_text(F.concat(F.substring(uuid, 1, 35), F.lit("X")), "UUID").alias("bad_letter"),
    )


def cast_line_end(spark, folder):
    """A line end behind a value makes it unfit for every type with a tight shape."""
    end = F.lit("\n")
    moment = F.col("o_orderdate")
    digest = F.md5(text("o_orderkey"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    spelled = {
        "Int32": text("o_orderkey"), "Int64": text("o_orderkey"), "UInt32": text("o_orderkey"), "Bool": F.lit("true"),
        "Date": moment.cast("date").cast("string"), "DateTime": iso_text(moment), "UUID": uuid,
    }
    return table(spark, folder, "orders").select(
        "o_orderkey",
        *[cast_text(value, kind).isNotNull().alias(f"plain_{kind}") for kind, value in spelled.items()],
        *[cast_text(F.concat(value, end), kind).isNotNull().alias(f"ended_{kind}") for kind, value in spelled.items()],
    )


def cast_nested(spark, folder):
    """Arrays and maps from their JSON text."""
    as_text = table(spark, folder, "embeddings").select("vec_id", F.to_json("embedding").alias("items"))
    items = cast_text(F.col("items"), "Array(Float32)")
    keyed = cast_text(F.format_string('{"a":%d,"b":7}', F.col("vec_id")), "Map(String, Int64)")
    return as_text.select(
        "vec_id",
        F.size(items).cast("bigint").alias("item_count"),
        F.element_at(items, 1).cast("double").alias("first_item"),
        F.element_at(keyed, "a").alias("a"),
    )


def unquote_query(spark, folder):
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        "c_custkey",
        unquote(F.concat(F.lit('"'), name, F.lit('"'))).alias("enclosed"),
        unquote(F.concat(F.lit('"'), name)).alias("left_only"),
        unquote(F.concat(name, F.lit(' "x" '), name)).alias("inside"),
        unquote(F.concat(F.lit('"{'), name, F.lit('}"'))).alias("braced"),
        unquote(F.concat(F.lit('""'), name, F.lit('""'))).alias("twice"),
    )


def safe_name_query(spark, folder):
    return table(spark, folder, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


def parse_datetime_formats(spark, folder):
    """Three spellings of order dates and one that fits no format."""
    day = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd HH:mm"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", spelled.alias("spelled"))
    return orders.select(
        "o_orderkey",
        parse_datetime(F.col("spelled"), ["yyyy-MM-dd HH:mm", "dd/MM/yyyy", "yyyyMMdd"]).alias("parsed"),
        parse_datetime(F.col("o_orderpriority"), ["yyyy-MM-dd HH:mm"]).alias("unparsed"),
    )


QUERIES = {
    "cast_line_end": cast_line_end,
    "cast_int": cast_int,
    "cast_bigint": cast_bigint,
    "cast_double": cast_double,
    "cast_date": cast_date,
    "cast_datetime": cast_datetime,
    "cast_bool": cast_bool,
    "cast_uuid": cast_uuid,
    "cast_nested": cast_nested,
    "unquote": unquote_query,
    "safe_name": safe_name_query,
    "parse_datetime_formats": parse_datetime_formats,
}

UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"

SQL = {
    "cast_line_end": "SELECT o_orderkey, "
    + ", ".join(f"{v} AS {p}_{t}" for p, v in (("plain", "true"), ("ended", "false")) for t in ("Int32", "Int64", "UInt32", "Bool", "Date", "DateTime", "UUID"))
    + " FROM orders",
    "cast_int": (
        "SELECT o_orderkey, TRY_CAST(o_orderkey AS INTEGER) AS plain, TRY_CAST(-o_orderkey AS INTEGER) AS negative, "
        "TRY_CAST(o_orderkey AS INTEGER) AS signed, CAST(NULL AS INTEGER) AS padded, "
        "TRY_CAST(o_orderkey * 1000000 AS INTEGER) AS large, CAST(NULL AS INTEGER) AS decimals, "
        "CAST(NULL AS INTEGER) AS commas, CAST(NULL AS INTEGER) AS word, CAST(NULL AS INTEGER) AS empty FROM orders"
    ),
    "cast_bigint": (
        "SELECT o_orderkey, o_orderkey * 1000000 AS large, "
        "TRY_CAST(CAST(o_orderkey AS HUGEINT) * 1000000000000000 AS BIGINT) AS huge, CAST(NULL AS BIGINT) AS decimals, "
        "CAST(NULL AS BIGINT) AS padded, CASE WHEN o_orderkey <= 65535 THEN CAST(o_orderkey AS INTEGER) END AS unsigned, "
        "CASE WHEN o_orderkey = 0 THEN CAST(0 AS BIGINT) END AS unsigned_negative FROM orders"
    ),
    "cast_double": (
        "SELECT o_orderkey, o_totalprice AS plain, CAST(o_orderkey AS DOUBLE) * 100 AS exponent, "
        "CAST(NULL AS DOUBLE) AS commas, CAST(NULL AS DOUBLE) AS words, CAST(NULL AS DOUBLE) AS short_words, "
        "CAST(o_totalprice AS DECIMAL(12,2)) AS exact FROM orders"
    ),
    "cast_date": (
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS plain, CAST(NULL AS DATE) AS slashes, CAST(NULL AS DATE) AS month_only, "
        "TRY_CAST(strftime(o_orderdate, '%Y-%d-%m') AS DATE) AS swapped, "
        "TRY_CAST(strftime(o_orderdate, '%Y-%m-31') AS DATE) AS day_31, CAST(NULL AS DATE) AS with_time FROM orders"
    ),
    "cast_datetime": (
        "SELECT event_id, ts AS plain, ts AS lower_case, date_trunc('minute', ts) AS minutes, CAST(NULL AS TIMESTAMP) AS blank_between, "
        "CAST(NULL AS TIMESTAMP) AS date_only, CAST(NULL AS TIMESTAMP) AS with_zone, CAST(NULL AS TIMESTAMP) AS hour_25 FROM events"
    ),
    "cast_bool": (
        "SELECT doc_id, quality = 1 AS digit, quality = 1 AS yes_no, toxic = 1 AS true_false, CAST(NULL AS BOOLEAN) AS letter, "
        "CASE doc_id WHEN 1 THEN true WHEN 0 THEN false END AS number FROM labels"
    ),
    "cast_uuid": (
        f"SELECT event_id, {UUID_SQL} AS plain, {UUID_SQL} AS upper_case, CAST(NULL AS VARCHAR) AS no_hyphens, "
        "CAST(NULL AS VARCHAR) AS bad_letter FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events)"
    ),
    "cast_nested": (
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS item_count, CAST(embedding[1] AS DOUBLE) AS first_item, vec_id AS a FROM embeddings"
    ),
    "unquote": (
        "SELECT c_custkey, c_name AS enclosed, '\"' || c_name AS left_only, c_name || ' \"x\" ' || c_name AS inside, "
        "'\"{' || c_name || '}\"' AS braced, '\"' || c_name || '\"' AS twice FROM customer"
    ),
    "safe_name": "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM pages",
    "parse_datetime_formats": (
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN date_trunc('minute', o_orderdate) "
        "ELSE date_trunc('day', o_orderdate) END AS parsed, CAST(NULL AS TIMESTAMP) AS unparsed FROM orders"
    ),
}
