from rowferry.plans.export import compile_export, count_export, export_preview, prepare_export
from rowferry.plans.spec import ExportSpec, JoinSpec, LoadSpec, decode_delimiter

__all__ = [
    "ExportSpec",
    "JoinSpec",
    "LoadSpec",
    "compile_export",
    "count_export",
    "decode_delimiter",
    "export_preview",
    "prepare_export",
]
