"""Delimited text in: standard, headerless, lenient, preview and sample reads.

Every read gives text columns; types are applied by a projection afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.text import clean_header, is_complex_line, read_null, split_quoted, trim_cells
from rowferry.plans.spec import PREVIEW_ROWS, SAMPLE_ROWS, decode_delimiter, quote_name, unused_name
from rowferry.sources.records import Layout, Records, cut_records, file_layout, fixed_lines, literal_path, place

# Fixed value: what a preview shows for a file with only a header.
NO_DATA = "(No data)"

# Stands for a cell with nothing while parsing, apart from quoted empty text.
NULL_MARK = "\x00null\x00"


def csv_options(sep: str, header: bool = False, multi_line: bool = True) -> dict[str, str]:
    """Reader options of the standard dialect: a quote is escaped by doubling it.

    A cell with nothing is NULL, a quoted cell with nothing is empty text.
    """
    return {
        "sep": sep,
        "header": str(header).lower(),
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "encoding": "UTF-8",
        "mode": "PERMISSIVE",
        "nullValue": NULL_MARK,
        "maxCharsPerColumn": "-1",
    }


def _cells(spark: SparkSession, record: str, sep: str) -> list[str | None]:
    """The cells of one record, as many as it has."""
    one = spark.createDataFrame([(record,)], "record string")
    options = csv_options(sep)
    width = one.select(F.schema_of_csv(F.lit(record), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})).head()[0].count("_c")
    schema = ", ".join(f"c{i} string" for i in range(max(width, 1)))
    return list(one.select(F.from_csv("record", schema, options).alias("cells")).select("cells.*").head())


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a header: blank ones are numbered, repeated ones get their number behind."""
    lower = [(c or "").lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


MISFIT = "misfit"


def _named(cells: DataFrame, prefix: str, names: Sequence[str], misfit: bool, taken: Sequence[str] = ()) -> DataFrame:
    """Text columns from parsed cells; ``misfit`` marks records with another number of cells."""
    columns = [F.col(f"{prefix}c{i}").alias(n) for i, n in enumerate(names)]
    if len(names) == 1:
        columns = [read_null(F.col(f"{prefix}c0")).alias(names[0])]
    if misfit:
        # The reader gives the record at fault only beside another column.
        any_cell = F.col(f"{prefix}c0").isNull() | (F.length(f"{prefix}c0") >= 0)
        columns.append((F.col(f"{prefix}bad").isNotNull() & any_cell).alias(unused_name(MISFIT, taken or names)))
    return cells.select(*columns)


def _parsed(records: DataFrame, names: Sequence[str], sep: str, misfit: bool, taken: Sequence[str] = ()) -> DataFrame:
    """Columns from records."""
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "bad string"])
    options = csv_options(sep) | {"columnNameOfCorruptRecord": "bad"}
    cells = records.where("record <> ''").select(F.from_csv("record", schema, options).alias("cells"))
    return _named(cells, "cells.", names, misfit, taken)


def _scanned(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], sep: str, header: bool, misfit: bool, others: Sequence[str], taken: Sequence[str]
) -> DataFrame:
    """Columns of plain files: lines are split, cut and pruned by the scan itself, which leaves out each file's header."""
    options = csv_options(sep, header, multi_line=False) | {"columnNameOfCorruptRecord": "bad"}
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), *(["bad string"] if misfit else [])])
    cells = spark.read.schema(schema).options(**options).csv(path if isinstance(path, str) else list(path))
    if others:
        cells = cells.where(~F.col("_metadata.file_path").isin(list(others)))
    return _named(cells, "", names, misfit, taken)


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    header: bool = True,
    columns: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    multi_char: bool = False,
    misfit: bool = False,
) -> DataFrame:
    """Scan delimited files into text columns.

    Files are cut into records in parallel, also where cells span lines. Empty
    lines are no records; in files of one column ``\\N`` is a cell without a
    value. Every file's first record is its header; files whose
    headers differ are matched by column name. ``columns`` keeps only these, in
    this order. Without a header the names are Column1..N, as many as the first
    record of the first file has; ``rename`` maps names to new ones.
    ``misfit`` adds a last column that tells records with too few or too many cells.
    """
    sep = decode_delimiter(sep, multi_char)
    df = _all_files(spark, path, sep, header, misfit)
    if columns is not None:
        df = df.select(*[quote_name(c) for c in columns], *([quote_name(df.columns[-1])] if misfit else []))
    return df.withColumnsRenamed(dict(rename)) if rename else df


def _nothing(spark: SparkSession, misfit: bool) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(MISFIT, T.BooleanType())] if misfit else []))


def _all_files(spark: SparkSession, path: str | Sequence[str], sep: str, header: bool, misfit: bool) -> DataFrame:
    """Plain files by one scan, the others as records; each part with the names of its header."""
    first = next(iter(_head(spark, path, 1)[1]), None)
    if first is None:
        return _nothing(spark, misfit)
    layout = file_layout(spark, path, sep, first, header)
    found = cut_records(spark, path, sep, layout.others, layout.spanning) if layout.others else None
    if not header:
        return _without_header(spark, path, sep, misfit, layout, found)
    # (first file that begins with it, header, its part), the parts' column names not yet settled.
    groups = [] if layout.first is None else [(layout.first, layout.head, None)]
    if found is not None:
        # One row for each header in use.
        heads = found.heads.groupBy("record").agg(F.min("file").alias("file")).collect()
        groups += [(h.file, h.record, rows) for h, rows in zip(heads, _bodies(found, [h.record for h in heads]))]
    if not groups:
        return _nothing(spark, misfit)
    groups.sort(key=lambda g: g[0])
    names = [header_names(_cells(spark, record, sep)) for _, record, _ in groups]
    every = list(dict.fromkeys(n for own in names for n in own))
    parts = [
        _scanned(spark, path, own, sep, True, misfit, layout.others, every) if rows is None else _parsed(rows, own, sep, misfit, every)
        for own, (_, _, rows) in zip(names, groups)
    ]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.select(*[quote_name(c) for c in every], *([quote_name(unused_name(MISFIT, every))] if misfit else []))


def _without_header(spark: SparkSession, path: str | Sequence[str], sep: str, misfit: bool, layout: Layout, found: Records | None) -> DataFrame:
    firsts = [] if layout.first is None else [(layout.first, None)]
    if found is not None and (head := found.heads.orderBy("file").head()) is not None:
        firsts.append((head.file, head.record))
    if not firsts:
        return _nothing(spark, misfit)
    record = min(firsts)[1] or next(iter(_head(spark, path, 1)[1]))
    names = [f"Column{i + 1}" for i in range(len(_cells(spark, record, sep)))]
    parts = [] if layout.first is None else [_scanned(spark, path, names, sep, False, misfit, layout.others, names)]
    if found is not None:
        parts.append(_parsed(found.rows, names, sep, misfit))
    return reduce(DataFrame.unionByName, parts)


def _bodies(found: Records, headers: Sequence[str]) -> list[DataFrame]:
    """The records behind the header, for each header; what stands before one is empty."""
    heads = found.heads.select("file", F.col("line").alias("head_line"), F.col("piece").alias("head_piece"), F.col("record").alias("header"))
    body = found.rows.join(heads, "file").where("line > head_line OR line = head_line AND piece > head_piece")
    return [body.where(F.col("header") == h) for h in headers]


def record_lines(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_char: bool = False) -> DataFrame:
    """Records that are not empty as ``value``, with the ``position`` that orders them in one run of the plan."""
    sep = decode_delimiter(sep, multi_char)
    layout = file_layout(spark, path, sep, None, False)
    plain = spark.read.text(path if isinstance(path, str) else list(path))
    if layout.others:
        plain = plain.where(~F.col("_metadata.file_path").isin(list(layout.others)))
    plain = plain.where(F.length("value") > 0).select("value", *place())
    lines = plain.select("value", F.struct("file", "line", F.lit(0).alias("piece")).alias("position"))
    if not layout.others:
        return lines
    rows = cut_records(spark, path, sep, layout.others, layout.spanning).rows.where("record <> ''")
    return lines.unionByName(rows.select(F.col("record").alias("value"), F.struct("file", "line", "piece").alias("position")))


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Non-empty lines with the ``position`` (file, split, line) that orders them in one run of the plan."""
    return spark.read.text(path).where(F.length("value") > 0).select("value", F.struct(*place()).alias("position"))


def _head(spark: SparkSession, path: str | Sequence[str], n: int) -> tuple[str | None, list[str]]:
    """The first file that has a line with something in it, and its first ``n`` such lines.

    Only files of no bytes are passed over by their size; the others are looked
    at one after the other, which reads as far as ``n`` lines.
    """
    sizes = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "length").where("length > 0")
    last = None
    while True:
        first = sizes.agg(F.min("path")).head()[0] if last is None else sizes.where(F.col("path") > last).agg(F.min("path")).head()[0]
        if first is None:
            return None, []
        lines = spark.read.text(literal_path(first)).where(F.length("value") > 0).take(n)
        if lines:
            return first, [r.value for r in lines]
        last = first


def _without_headers(spark: SparkSession, path: str | Sequence[str], first: str) -> DataFrame:
    """Non-empty lines without the first one of every file that is the header line.

    A later line that happens to equal the header is data and stays. Where a
    header occurs once in its file its text tells it; lines of the files where
    it does not are written once, and their first ones told by their place.
    """
    lines = text_lines(spark, path)
    line, is_head = F.col("position.line"), F.col("value") == F.lit(first)
    facts = lines.groupBy(F.col("position.file").alias("file")).agg(
        F.count_if(is_head).alias("n"), F.min(line).alias("first"), F.min(F.when(is_head, line)).alias("head")
    )
    unclear = (F.col("n") > 1) | (F.col("n") == 1) & (F.col("first") != F.col("head"))
    others = [r.file for r in facts.where(unclear).select("file").collect()]
    plain = lines.where(~is_head)
    if not others:
        return plain.select("value")
    fixed = fixed_lines(spark, path, others).where(F.length("value") > 0)
    firsts = fixed.groupBy("file").agg(F.min("line").alias("line"))
    at_head = fixed.where(is_head).join(firsts, ["file", "line"]).select("file", "line")
    kept = fixed.join(at_head, ["file", "line"], "left_anti")
    return plain.where(~F.col("position.file").isin(others)).select("value").unionByName(kept.select("value"))


def read_lenient(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    header: bool = True,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Scan line by line: a quote toggles quoting, cells are trimmed, empty lines dropped.

    Column names come from the first line of the first file that has one (every
    file's first line is then a header) or are Column1..N. Short lines are
    padded with NULL, cells beyond the header are dropped.
    """
    sep = decode_delimiter(sep)
    first = next(iter(_head(spark, path, 1)[1]), None)
    if first is None:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names or []]))
    head = spark.createDataFrame([(first,)], "value string").select(split_quoted(F.col("value"), sep).alias("cells"))
    found = head.select(F.transform("cells", clean_header).alias("cells")).head().cells
    rows = _without_headers(spark, path, first) if header else text_lines(spark, path)
    names = list(names) if names else (found if header else [f"Column{i}" for i in range(1, len(found) + 1)])
    cells = rows.select(split_quoted(F.col("value"), sep).alias("cells"))
    return cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def preview_file(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    header: bool = True,
    keep_quotes: bool | None = None,
) -> DataFrame:
    """The first 100 lines with something in them by the lenient rules; a header counts as one of them.

    They are those of the first file that has any. A file with only a header
    gives one ``(No data)`` row, files without lines no rows and no columns.
    """
    sep = decode_delimiter(sep)
    _, lines = _head(spark, path, PREVIEW_ROWS)
    if not lines:
        return spark.createDataFrame([], T.StructType([]))
    cut = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line int, value string")
    cut = cut.select("line", split_quoted(F.col("value"), sep, keep_quotes).alias("cells"))
    first = cut.where("line = 0").select(F.transform("cells", clean_header).alias("cells")).head().cells
    names = first if header else [f"Column{i}" for i in range(1, len(first) + 1)]
    if header and len(lines) == 1:
        return spark.createDataFrame([tuple(NO_DATA for _ in names)], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    rows = cut.where("line > 0") if header else cut
    return rows.orderBy("line").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def sample_file(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    header: bool = True,
    n: int = SAMPLE_ROWS,
    loose: bool | None = None,
) -> DataFrame:
    """The first 1000 records of the first file with any by the standard rules, cells trimmed.

    A header counts as one of them. ``loose`` reads the first 100 lines by the
    lenient rules instead, without quotes; if it is not given, a first line
    with many delimiters and quotes asks for that. Only the head of the file is
    read.
    """
    sep = decode_delimiter(sep)
    first, lines = _head(spark, path, 1)
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    if loose is None:
        loose = not spark.createDataFrame([(lines[0],)], "value string").where(is_complex_line(F.col("value"), sep)).isEmpty()
    if loose:
        return preview_file(spark, literal_path(first), sep, header, keep_quotes=False)
    records = spark.read.options(**csv_options(sep, header)).csv(literal_path(first))
    if not header:
        records = records.toDF(*[f"Column{i}" for i in range(1, len(records.columns) + 1)])
    return trim_cells(spark.createDataFrame(records.take(n - header), records.schema))


