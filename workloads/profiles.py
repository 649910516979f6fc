"""Type inference and file and table profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from rowferry.functions.text import is_complex_line
from rowferry.operators.infer import infer_types
from rowferry.operators.profile import (
    candidate_keys,
    candidate_keys_composite,
    column_inventory,
    delimiter_widths,
    detect_delimiter,
    estimate_size,
    validate_width,
)
from rowferry.sinks.files import export_delimited
from rowferry.sources.delimited import read_delimited, record_lines, text_lines
from workloads.common import LINE_TYPES, fresh_path, table, text


def infer_types_query(spark, folder):
    path = fresh_path(spark, "infer")
    export_delimited(table(spark, folder, "lineitem"), path)
    return infer_types(read_delimited(spark, path))


def infer_types_mixed(spark, folder):
    """Columns whose cells disagree, are sparse or fit several types."""
    events = table(spark, folder, "events")
    key, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    digest = F.md5(text("event_id"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    is_error = kind == "error"
    return infer_types(
        events.select(
            F.when(is_error, kind).otherwise(key.cast("string")).alias("number_or_word"),
            F.concat(text("event_id"), F.lit("000000000000")).alias("large_number"),
            F.when(is_error, F.lit("yes")).otherwise("1").alias("flag"),
            F.when(is_error, F.lit("0")).otherwise("1").alias("zero_one"),
            F.when(is_error, F.lit("")).otherwise(text("value")).alias("real_or_empty"),
            F.when(is_error, text("event_id")).otherwise(text("value")).alias("whole_or_real"),
            F.when(is_error, F.lit("")).alias("nothing"),
            F.col("ts").cast("date").cast("string").alias("day"),
            F.replace(text("ts"), F.lit(" "), F.lit("T")).alias("moment"),
            text("ts").alias("spaced_moment"),
            F.when(is_error, F.upper(uuid)).otherwise(uuid).alias("identifier"),
            F.concat(F.lit(" "), text("event_id")).alias("padded_number"),
        )
    )


def validate_types_by_inference(spark, folder):
    """Inferred types of customers as a table would be created from them."""
    return infer_types(table(spark, folder, "customer").select(*[text(c).alias(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]))


def validate_width_query(spark, folder):
    """Every exported line has as many cells as the first."""
    path = fresh_path(spark, "width")
    export_delimited(table(spark, folder, "lineitem"), path, "|", header=False)
    return validate_width(text_lines(spark, path), "|")


def validate_width_spanning(spark, folder):
    """Texts with line ends in their cells: records count, not lines."""
    path = fresh_path(spark, "width-spanning")
    export_delimited(table(spark, folder, "documents"), path, header=False)
    return validate_width(record_lines(spark, path), ",")


def validate_width_ragged(spark, folder):
    """Lines of words: the widths differ."""
    path = fresh_path(spark, "ragged")
    documents = table(spark, folder, "documents")
    line = F.concat(text("doc_id"), F.lit(","), F.regexp_replace("text", r"[\s,\"\x00-\x20\x7f-\xa0  ]+", ","))
    documents.select("doc_id", line.alias("value")).orderBy("doc_id").select("value").write.text(path)
    return validate_width(text_lines(spark, path), ",")


def estimate_size_query(spark, folder):
    """Whole rows; the number with a fraction is told to the cent."""
    customer = table(spark, folder, "customer")
    return estimate_size(customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")))


def candidate_keys_query(spark, folder):
    return candidate_keys(table(spark, folder, "orders"))


def candidate_keys_composite_query(spark, folder):
    """Keys of up to two columns, over all columns of a table without a key of one."""
    return candidate_keys_composite(table(spark, folder, "lineitem"))


def column_inventory_text(spark, folder):
    return column_inventory(table(spark, folder, "documents"))


def detect_delimiter_query(spark, folder):
    path = fresh_path(spark, "detect")
    export_delimited(table(spark, folder, "lineitem"), path, "|", header=False)
    return detect_delimiter(text_lines(spark, path))


def delimiter_widths_query(spark, folder):
    path = fresh_path(spark, "delimiter-widths")
    export_delimited(table(spark, folder, "customer"), path, ";", header=False)
    return delimiter_widths(text_lines(spark, path))


def complex_lines(spark, folder):
    """Lines with more than ten separators and quotes, over the raw pages."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", is_complex_line(F.col("html"), ",").alias("is_complex"))


QUERIES = {
    "infer_types": infer_types_query,
    "infer_types_mixed": infer_types_mixed,
    "infer_types_table": validate_types_by_inference,
    "validate_width": validate_width_query,
    "validate_width_ragged": validate_width_ragged,
    "validate_width_spanning": validate_width_spanning,
    "estimate_size": estimate_size_query,
    "candidate_keys": candidate_keys_query,
    "candidate_keys_composite": candidate_keys_composite_query,
    "column_inventory_text": column_inventory_text,
    "detect_delimiter": detect_delimiter_query,
    "delimiter_widths": delimiter_widths_query,
    "complex_lines": complex_lines,
}


def _composite_keys_sql(table_name, columns):
    """Every column and every pair of columns, counted one by one; pairs that hold a key are left out."""

    def unique(*names):
        return f"SELECT count(*) > 0 AND count(DISTINCT ({', '.join(names)})) = count(*) AND " + " AND ".join(f"count({c}) = count(*)" for c in names)

    single = [f"({unique(c)} FROM {table_name}) AS {c}" for c in columns]
    found = [f"SELECT '{c}' AS key_columns, 1 AS n_columns FROM single WHERE {c}" for c in columns]
    found += [
        f"SELECT '{a},{b}', 2 FROM single WHERE NOT {a} AND NOT {b} AND ({unique(a, b)} FROM {table_name})" for a, b in combinations(columns, 2)
    ]
    return (
        f"WITH single AS (SELECT {', '.join(single)}), found AS ({' UNION ALL '.join(found)}) "
        f"SELECT key_columns, CAST(n_columns AS INTEGER) AS n_columns, (SELECT count(*) FROM {table_name}) AS row_count FROM found"
    )


def _whole_type(table_name, column):
    return (
        f"SELECT '{column}' AS column_name, CASE WHEN max({column}) <= 2147483647 THEN 'Int32' ELSE 'Int64' END "
        f"AS type_name FROM {table_name}"
    )


def _type(table_name, column, name):
    """The type that every text of the column casts to, else String."""
    text = {"DateTime": f"strftime({column}, '%Y-%m-%dT%H:%M:%S')"}.get(name, f"CAST({column} AS VARCHAR)")
    kinds = {"Float64": "DOUBLE", "DateTime": "TIMESTAMP", "Int32": "INTEGER", "Int64": "BIGINT"}
    if name == "String":
        fits = f"count({column}) = count(TRY_CAST({text} AS DOUBLE))"
        return f"SELECT '{column}' AS column_name, CASE WHEN {fits} THEN 'Float64' ELSE 'String' END AS type_name FROM {table_name}"
    fits = f"count({column}) > 0 AND count({column}) = count(TRY_CAST({text} AS {kinds[name]}))"
    return f"SELECT '{column}' AS column_name, CASE WHEN {fits} THEN '{name}' ELSE 'String' END AS type_name FROM {table_name}"


def _line_type(column, name):
    return _whole_type("lineitem", column) if name in ("Int32", "Int64") else _type("lineitem", column, name)


def _has_error(column, if_error, otherwise):
    return (
        f"SELECT '{column}' AS column_name, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 "
        f"THEN '{if_error}' ELSE '{otherwise}' END AS type_name FROM events"
    )


RAGGED = (
    "SELECT doc_id, len(string_split(CAST(doc_id AS VARCHAR) || ',' || "
    "regexp_replace(text, '[\\s,\"\\x00-\\x20\\x7f-\\x{a0}\\x{2028}\\x{2029}]+', ',', 'g'), ',')) AS width FROM documents"
)

SQL = {
    "infer_types": " UNION ALL ".join(_line_type(c, t) for c, t in LINE_TYPES.items()),
    "infer_types_mixed": " UNION ALL ".join(
        [
            _has_error("number_or_word", "String", "Int32"),
            "SELECT 'large_number', CASE WHEN count(*) > 1 THEN 'Int64' ELSE 'Int32' END FROM events",
            _has_error("flag", "Bool", "Int32"),
            _has_error("zero_one", "Int32", "Int32"),
            _has_error("real_or_empty", "Float64", "Float64"),
            _has_error("whole_or_real", "Float64", "Float64"),
            _has_error("nothing", "String", "String"),
            _has_error("day", "Date", "Date"),
            _has_error("moment", "DateTime", "DateTime"),
            _has_error("spaced_moment", "String", "String"),
            _has_error("identifier", "UUID", "UUID"),
            _has_error("padded_number", "Float64", "Float64"),
        ]
    ),
    "infer_types_table": " UNION ALL ".join(
        [
            _whole_type("customer", "c_custkey"),
            _type("customer", "c_name", "String"),
            _whole_type("customer", "c_nationkey"),
            _type("customer", "c_acctbal", "Float64"),
            _type("customer", "c_mktsegment", "String"),
        ]
    ),
    "validate_width": (
        "SELECT count(*) AS line_count, CAST(11 AS INTEGER) AS first_width, CAST(11 AS INTEGER) AS min_width, "
        "CAST(11 AS INTEGER) AS max_width, true AS is_valid FROM lineitem"
    ),
    "validate_width_spanning": (
        "SELECT count(*) AS line_count, CAST(5 AS INTEGER) AS first_width, CAST(5 AS INTEGER) AS min_width, "
        "CAST(5 AS INTEGER) AS max_width, true AS is_valid FROM documents"
    ),
    "validate_width_ragged": (
        "SELECT count(*) AS line_count, CAST(min_by(width, doc_id) AS INTEGER) AS first_width, "
        "CAST(min(width) AS INTEGER) AS min_width, CAST(max(width) AS INTEGER) AS max_width, "
        f"min(width) = max(width) AS is_valid FROM ({RAGGED})"
    ),
    "estimate_size": (
        "SELECT count(*) AS row_count, count(*) * 100 AS estimated_bytes, "
        "CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) "
        "+ strlen(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) + strlen(c_mktsegment) + 5) AS BIGINT) AS text_bytes FROM customer"
    ),
    "candidate_keys": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) = count(*) AS is_key FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
    "candidate_keys_composite": _composite_keys_sql("lineitem", tuple(LINE_TYPES)),
    "column_inventory_text": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS distinct_count FROM documents"
        for c, t in {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}.items()
    ),
    "detect_delimiter": "SELECT '|' AS delimiter, CAST(11 AS INTEGER) AS width, count(*) AS lines FROM lineitem",
    "delimiter_widths": (
        "SELECT delimiter, CAST(width AS INTEGER) AS width, count(*) AS lines FROM customer, "
        "(VALUES (',', 1), (chr(9), 1), ('|', 1), (';', 5)) AS d(delimiter, width) GROUP BY ALL"
    ),
    "complex_lines": (
        "SELECT page_id, length(html) - length(replace(html, ',', '')) > 10 "
        "AND length(html) - length(replace(html, '\"', '')) > 10 AS is_complex FROM pages"
    ),
}
