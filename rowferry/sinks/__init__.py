from rowferry.sinks.files import export_delimited, export_format, export_name, export_quoted, run_export
from rowferry.sinks.tables import LoadResult, append_rows, create_table, load_file, load_outcome

__all__ = [
    "LoadResult",
    "append_rows",
    "create_table",
    "export_delimited",
    "export_format",
    "export_name",
    "export_quoted",
    "load_file",
    "load_outcome",
    "run_export",
]
