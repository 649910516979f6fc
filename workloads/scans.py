"""Sources: delimited scans, previews, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rowferry.functions.casting import typed_projection
from rowferry.operators.profile import column_inventory, table_inventory
from rowferry.sinks.files import export_delimited, export_quoted
from rowferry.sources.delimited import preview_file, read_delimited, read_lenient, sample_file
from rowferry.sources.tables import catalog_inventory, preview_table, scan_table
from workloads.common import DOCUMENT_TYPES, LINE_TYPES, ORDER_TYPES, fresh_path, fresh_table, table

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def scan_csv(spark, folder):
    """Texts with quotes, separators and line ends survive the round trip."""
    path = fresh_path(spark, "scan-csv")
    export_delimited(table(spark, folder, "documents"), path)
    return typed_projection(read_delimited(spark, path), DOCUMENT_TYPES)


def scan_csv_records(spark, folder):
    """Every value in quotes, doubled quotes and line ends within."""
    path = fresh_path(spark, "scan-records")
    text = F.concat(F.lit('"'), F.col("text"), F.lit('",\r\n""'))
    export_quoted(table(spark, folder, "documents").withColumn("text", text), path)
    back = typed_projection(read_delimited(spark, path), DOCUMENT_TYPES)
    return back.withColumn("text", F.expr("substring(text, 2, length(text) - 7)"))


def _line(frame):
    return F.concat_ws(",", *[F.col(c).cast("string") for c in frame.columns])


def scan_cr(spark, folder):
    """Files whose records end at carriage returns, one of them within quotes."""
    path = fresh_path(spark, "scan-cr")
    customer = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('\r"""')).alias("c_name"), "c_nationkey")
    files = customer.repartition(3, "c_custkey").groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list(_line(customer)).alias("lines"))
    whole = F.concat(F.lit("c_custkey,c_name,c_nationkey\r\r"), F.array_join("lines", "\r"), F.lit("\r"))
    files.select("part", whole.alias("value")).write.partitionBy("part").text(path)
    return typed_projection(read_delimited(spark, f"{path}/*"), {"c_custkey": "Int64", "c_name": "String", "c_nationkey": "Int32"})


def scan_blank_lines(spark, folder):
    """Blank lines before the header and between records are none; a record of blanks is one."""
    path = fresh_path(spark, "scan-blank")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lines = nation.coalesce(1).sortWithinPartitions("n_nationkey").select(
        F.when(F.col("n_nationkey") == 0, F.lit("\n\r\n\nn_nationkey,n_name,n_regionkey\n , , \n")).otherwise(F.lit("\n\n")), _line(nation)
    )
    lines.select(F.concat(*[F.col(f"`{c}`") for c in lines.columns])).write.text(path)
    return read_delimited(spark, path)


def scan_empty_first_part(spark, folder):
    """A folder that begins with empty files, read in all four ways: rows of each."""
    path = fresh_path(spark, "scan-empty-first")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    nation.select(_line(nation)).where("false").write.text(path)
    export_delimited(nation.coalesce(1).orderBy("n_nationkey"), path, mode="append")
    ways = {"standard": read_delimited, "lenient": read_lenient, "preview": preview_file, "sample": sample_file}
    frames = [read(spark, path).select(F.lit(name).alias("way"), "n_nationkey", "n_name") for name, read in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def scan_header_order(spark, folder):
    """Files of one folder with their columns in different order, one with a column less."""
    path = fresh_path(spark, "scan-header-order")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    export_delimited(orders.where("o_orderkey % 3 = 0"), path)
    export_delimited(orders.where("o_orderkey % 3 = 1").select("o_totalprice", "o_orderkey", "o_custkey"), path, mode="append")
    export_delimited(orders.where("o_orderkey % 3 = 2").select("o_custkey", "o_orderkey"), path, mode="append")
    return typed_projection(read_delimited(spark, path), {c: ORDER_TYPES[c] for c in orders.columns})


def scan_tsv(spark, folder):
    path = fresh_path(spark, "scan-tsv")
    export_delimited(table(spark, folder, "orders"), path, r"\t")
    return typed_projection(read_delimited(spark, path, "tab"), ORDER_TYPES)


def scan_pipe(spark, folder):
    path = fresh_path(spark, "scan-pipe")
    export_delimited(table(spark, folder, "lineitem"), path, "|")
    return typed_projection(read_delimited(spark, path, "|"), LINE_TYPES)


def scan_csv_selected(spark, folder):
    path = fresh_path(spark, "scan-selected")
    export_delimited(table(spark, folder, "lineitem"), path)
    chosen = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return typed_projection(
        read_delimited(spark, path, columns=chosen), {c: LINE_TYPES[c] for c in chosen}
    )


def scan_headerless(spark, folder):
    path = fresh_path(spark, "scan-headerless")
    export_delimited(table(spark, folder, "customer"), path, header=False)
    df = read_delimited(spark, path, header=False, rename={"Column1": "custkey"})
    return typed_projection(
        df, {"custkey": "Int64", "Column2": "String", "Column3": "Int32", "Column4": "Float64", "Column5": "String"}
    )


def scan_lenient(spark, folder):
    """Quoted separators stay in their cell, cells are trimmed."""
    path = fresh_path(spark, "scan-lenient")
    customer = table(spark, folder, "customer")
    line = F.concat(
        F.col("c_custkey").cast("string"), F.lit(' ,  "'), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"),
        F.lit('" ,'), F.col("c_nationkey").cast("string"), F.lit(",  "),
    )
    customer.select(line.alias("value")).write.text(path)
    cells = read_lenient(spark, path, ",", header=False)
    return cells.select(
        F.col("Column1").alias("custkey"), F.col("Column2").alias("label"),
        F.col("Column3").alias("nationkey"), F.col("Column4").alias("rest"),
    )


def scan_lenient_tab(spark, folder):
    """Tab files: an enclosing quote pair goes, quotes inside stay, "{...}" keeps its quotes."""
    path = fresh_path(spark, "scan-lenient-tab")
    customer = table(spark, folder, "customer")
    line = F.concat(
        F.lit('"'), F.col("c_name"), F.lit("\t"), F.col("c_mktsegment"), F.lit('"\t"{'),
        F.col("c_custkey").cast("string"), F.lit('}"\t a "b" '), F.col("c_nationkey").cast("string"),
    )
    customer.select(line.alias("value")).write.text(path)
    cells = read_lenient(spark, path, "tab", header=False)
    return cells.select(
        F.col("Column1").alias("label"), F.col("Column2").alias("braced"), F.col("Column3").alias("inner_quotes")
    )


def _ordered_export(spark, folder, label):
    path = fresh_path(spark, label)
    export_delimited(table(spark, folder, "orders").orderBy("o_orderkey"), path)
    return path, ORDER_TYPES


def preview_file_query(spark, folder):
    path, types = _ordered_export(spark, folder, "preview-file")
    return typed_projection(preview_file(spark, path), types)


def sample_file_query(spark, folder):
    path, types = _ordered_export(spark, folder, "sample-file")
    return typed_projection(sample_file(spark, path), types)


def scan_table_query(spark, folder):
    name = fresh_table("scan")
    table(spark, folder, "supplier").write.option("path", fresh_path(spark, "scan-table")).saveAsTable(name)
    return scan_table(spark, name)


def table_inventory_query(spark, folder):
    return table_inventory({name: table(spark, folder, name) for name in TABLE_NAMES})


def catalog_inventory_query(spark, folder):
    """The tables of a database, counted through the catalog."""
    database = fresh_table("db")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, 'catalog')}'")
    for name in ("customer", "orders", "events"):
        table(spark, folder, name).write.saveAsTable(f"{database}.{name}")
    return catalog_inventory(spark, database)


def column_inventory_query(spark, folder):
    return column_inventory(table(spark, folder, "lineitem"))


def preview_table_query(spark, folder):
    return preview_table(table(spark, folder, "customer").orderBy("c_custkey"))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_csv_records": scan_csv_records,
    "scan_cr": scan_cr,
    "scan_blank_lines": scan_blank_lines,
    "scan_empty_first_part": scan_empty_first_part,
    "scan_header_order": scan_header_order,
    "scan_tsv": scan_tsv,
    "scan_pipe": scan_pipe,
    "scan_csv_selected": scan_csv_selected,
    "scan_headerless": scan_headerless,
    "scan_lenient": scan_lenient,
    "scan_lenient_tab": scan_lenient_tab,
    "preview_file": preview_file_query,
    "sample_file": sample_file_query,
    "scan_table": scan_table_query,
    "table_inventory": table_inventory_query,
    "catalog_inventory": catalog_inventory_query,
    "column_inventory": column_inventory_query,
    "preview_table": preview_table_query,
}

LINE_COLUMNS = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}

SQL = {
    "scan_csv": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "scan_csv_records": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "scan_cr": "SELECT c_custkey, c_name || chr(13) || '\"' AS c_name, c_nationkey FROM customer",
    "scan_blank_lines": (
        "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation "
        "UNION ALL SELECT ' ', ' ', ' '"
    ),
    "scan_empty_first_part": (
        "SELECT way, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation, "
        "(VALUES ('standard'), ('lenient'), ('preview'), ('sample')) AS w(way)"
    ),
    "scan_header_order": (
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS o_totalprice FROM orders"
    ),
    "scan_tsv": "SELECT * FROM orders",
    "scan_pipe": "SELECT * FROM lineitem",
    "scan_csv_selected": "SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem",
    "scan_headerless": (
        'SELECT c_custkey AS custkey, c_name AS "Column2", c_nationkey AS "Column3", '
        'c_acctbal AS "Column4", c_mktsegment AS "Column5" FROM customer'
    ),
    "scan_lenient": (
        "SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name || ', ' || c_mktsegment AS label, "
        "CAST(c_nationkey AS VARCHAR) AS nationkey, '' AS rest FROM customer"
    ),
    "scan_lenient_tab": (
        "SELECT c_name || chr(9) || c_mktsegment AS label, "
        "'\"{' || CAST(c_custkey AS VARCHAR) || '}\"' AS braced, "
        "'a \"b\" ' || CAST(c_nationkey AS VARCHAR) AS inner_quotes FROM customer"
    ),
    "preview_file": (
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 99"
    ),
    "sample_file": (
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 999"
    ),
    "scan_table": "SELECT * FROM supplier",
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLE_NAMES
    ),
    "catalog_inventory": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("customer", "orders", "events")
    ),
    "column_inventory": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS distinct_count FROM lineitem"
        for c, t in LINE_COLUMNS.items()
    ),
    "preview_table": "SELECT * FROM customer ORDER BY c_custkey LIMIT 100",
}
