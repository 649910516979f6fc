from rowferry.functions.casting import cast_text, is_rejected, require_cast, typed_projection
from rowferry.functions.text import (
    clean_header,
    iso_text,
    parse_datetime,
    safe_name,
    split_quoted,
    trim_cell,
    trim_cells,
    unquote,
)
from rowferry.functions.types import spark_type, type_name

__all__ = [
    "cast_text",
    "clean_header",
    "is_rejected",
    "iso_text",
    "parse_datetime",
    "require_cast",
    "safe_name",
    "spark_type",
    "split_quoted",
    "trim_cell",
    "trim_cells",
    "type_name",
    "typed_projection",
    "unquote",
]
