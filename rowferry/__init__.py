"""rowferry: move rows between tables and delimited files as Spark jobs."""

from rowferry.plans import ExportSpec, JoinSpec, LoadSpec, compile_export, count_export, export_preview, prepare_export
from rowferry.sinks import export_delimited, export_format, load_file, load_outcome, run_export
from rowferry.sources import preview_file, read_delimited, read_jdbc, read_lenient, sample_file
from rowferry.streaming import progress_rows, stream_load

__all__ = [
    "ExportSpec",
    "JoinSpec",
    "LoadSpec",
    "compile_export",
    "count_export",
    "export_delimited",
    "export_format",
    "export_preview",
    "load_file",
    "load_outcome",
    "prepare_export",
    "preview_file",
    "progress_rows",
    "read_delimited",
    "read_jdbc",
    "read_lenient",
    "run_export",
    "sample_file",
    "stream_load",
]
