"""Files out: delimited text and other formats, one part per task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.text import UNSAFE_NAME_CHARS, iso_text, spell_null
from rowferry.plans.export import Tables, prepare_export
from rowferry.plans.spec import ExportSpec, decode_delimiter, is_blank, quote_name

# Format name -> Spark writer, its options.
FORMATS = {
    "CSV": ("csv", {"header": "false"}),
    "CSVWithNames": ("csv", {"header": "true"}),
    "TabSeparated": ("csv", {"header": "false", "sep": "\t"}),
    "TabSeparatedWithNames": ("csv", {"header": "true", "sep": "\t"}),
    "JSON": ("json", {}),
    "JSONEachRow": ("json", {}),
    "Parquet": ("parquet", {}),
    "ORC": ("orc", {}),
    "Text": ("text", {}),
}
DEFAULT_FORMAT = "CSVWithNames"

# Blanks at the ends of cells belong to the data; a quote is escaped by doubling it.
DIALECT = {
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# Times keep all their microseconds; those with a zone are told in the session's.
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def as_text_cells(df: DataFrame) -> DataFrame:
    """What the text writer cannot write exactly, as text: times with all
    microseconds in ISO form (of the session's zone, which is not written),
    nested values as JSON."""
    cells = []
    for field in df.schema.fields:
        value = F.col(quote_name(field.name))
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = iso_text(value)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value, JSON_TIMES)
        if len(df.columns) == 1:
            value = spell_null(value.cast("string"))
        cells.append(value.alias(field.name))
    return df.select(*cells)


def _write(df: DataFrame, path: str, writer: str, options: dict[str, str], mode: str) -> int:
    counted = Observation()
    watched = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    watched.write.format(writer).options(**options).mode(mode).save(path)
    return counted.get["rows"]


def export_delimited(
    df: DataFrame,
    path: str,
    sep: str | None = None,
    header: bool = True,
    quote_all: bool = False,
    compression: str | None = None,
    mode: str = "errorifexists",
) -> int:
    """Write delimited text with a header line in every part; returns the rows written.

    Rows are counted by the write itself. Each task writes its own part, so
    nothing is gathered; parent folders are created.
    """
    options = DIALECT | {
        "sep": "," if sep is None else decode_delimiter(sep),
        "header": str(header).lower(),
        "quoteAll": str(quote_all).lower(),
    }
    if compression:
        options["compression"] = compression
    return _write(as_text_cells(df), path, "csv", options, mode)


def export_quoted(df: DataFrame, path: str, sep: str | None = None, **kwargs) -> int:
    """``export_delimited`` with quotes around every value."""
    return export_delimited(df, path, sep, quote_all=True, **kwargs)


def export_format(df: DataFrame, path: str, format_name: str | None = None, mode: str = "errorifexists") -> int:
    """Write in a named format; a blank or unknown name means delimited text with a header."""
    by_name = {name.lower(): choice for name, choice in FORMATS.items()}
    wanted = DEFAULT_FORMAT if is_blank(format_name) else format_name.strip()
    writer, options = by_name.get(wanted.lower(), FORMATS[DEFAULT_FORMAT])
    if writer == "csv":
        return _write(as_text_cells(df), path, writer, DIALECT | options, mode)
    if writer == "json":
        options = {"ignoreNullFields": "false"} | JSON_TIMES
    return _write(df, path, writer, options, mode)


def run_export(spec: ExportSpec, tables: Tables, folder: str, **kwargs) -> tuple[str, int]:
    """Write what a spec asks for under ``folder``; returns the path and the rows written."""
    path = f"{folder.rstrip('/')}/{export_name(spec.table)}"
    return path, export_delimited(prepare_export(spec, tables), path, spec.separator, **kwargs)


def export_name(table: str, extension: str = ".csv") -> str:
    """File name for a table: characters unsafe in names become ``_``."""
    return re.sub(UNSAFE_NAME_CHARS, "_", table) + extension
