from rowferry.sources.delimited import (
    preview_file,
    read_delimited,
    read_lenient,
    record_lines,
    sample_file,
    text_lines,
)
from rowferry.sources.jdbc import jdbc_options, read_jdbc
from rowferry.sources.tables import catalog_inventory, catalog_tables, preview_table, scan_table

__all__ = [
    "catalog_inventory",
    "catalog_tables",
    "jdbc_options",
    "preview_file",
    "preview_table",
    "read_delimited",
    "read_jdbc",
    "read_lenient",
    "record_lines",
    "sample_file",
    "scan_table",
    "text_lines",
]
