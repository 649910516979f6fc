"""Turn an export spec into one lazy DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.operators import joins
from rowferry.operators.limits import OrderKey, first_rows, first_rows_of_files, preview_rows, spread_sort
from rowferry.plans.spec import ExportSpec, JoinSpec, is_blank, quote_name, split_reference, unused_name

Tables = Mapping[str, DataFrame] | Callable[[str], DataFrame]


def _table(tables: Tables, name: str) -> DataFrame:
    name = name.replace('"', "")
    return (tables(name) if callable(tables) else tables[name]).alias(name)


def column_of(table: str, column: str) -> Column:
    return F.col(f"{quote_name(table)}.{quote_name(column)}")


def condition_of(join: JoinSpec, main_table: str) -> Column | None:
    """The join condition as a Column; None when it is blank."""
    if join.pairs:
        left = [column_of(*split_reference(local, main_table)) for local, _ in join.pairs]
        right = [column_of(join.table, column) for _, column in join.pairs]
        return joins.all_of([a == b for a, b in zip(left, right)])
    if is_blank(join.condition):
        return None
    return F.expr(re.sub(r'\."([^"]+)"', r".`\1`", join.condition))


def _array_columns(join: JoinSpec) -> tuple[str, str]:
    column = join.array_column.rpartition(".")[2]
    return f"{column}_item", f"{column}_index"


def _mentioned(spec: ExportSpec, df: DataFrame) -> list[str]:
    """Columns whose name occurs anywhere in the spec; a few too many do no harm."""
    texts = [*spec.columns, *spec.order_by]
    for join in spec.joins:
        texts += [join.condition or "", join.array_column or "", *join.order_by, *(c for pair in join.pairs for c in pair)]
    return [c for c in df.columns if any(c in text for text in texts)]


def _apply(frame: DataFrame, join: JoinSpec, spec: ExportSpec, tables: Tables, salt_hot_keys: bool) -> DataFrame:
    main_table = spec.table.replace('"', "")
    what, how = join.mode
    if what == "array":
        if is_blank(join.array_column):
            raise ValueError("an ARRAY join needs array_column")
        item, index = _array_columns(join)
        array = column_of(*split_reference(join.array_column, join.table))
        return joins.array_join(frame, array, item, keep_empty=how == "left", position=index)

    right = _table(tables, join.table)
    on = condition_of(join, main_table)
    pairs = join.equal_pairs(main_table, right.columns, frame.columns)
    if what == "any":
        if pairs is None:
            raise ValueError("an ANY join needs a condition of column equalities")
        keys = [column for _, _, column in pairs]
        chosen = joins.first_per_key(right, keys, join.order_by, _mentioned(spec, right))
        return frame.join(chosen.alias(join.table), on, how)
    if what == "product" or on is None:
        return joins.theta_join(frame, right, on, how)
    if what == "global":
        right = joins.broadcast_if_small(right)
    if pairs is None:
        terms, _ = join.equal_terms(main_table, right.columns, frame.columns)
        if salt_hot_keys and terms and how != "inner":
            left_keys = [column_of(table, column) for table, column, _ in terms]
            right_keys = [column_of(join.table, column) for _, _, column in terms]
            return joins.tracked_join(frame, right, on, left_keys, right_keys, how)
        return joins.theta_join(frame, right, on, how)
    if what == "global":
        return frame.join(right, on, how)

    left_keys = [column_of(table, column) for table, column, _ in pairs]
    right_keys = [column_of(join.table, column) for _, _, column in pairs]
    if how in ("left_semi", "left_anti"):
        return joins.filter_join(frame, right, left_keys, right_keys, how)
    if salt_hot_keys and how in ("left", "right", "full"):
        return joins.salted_join(frame, right, left_keys, right_keys, how)
    return frame.join(right, on, how)


def _joined(spec: ExportSpec, tables: Tables, salt_hot_keys: bool) -> DataFrame:
    frame = _table(tables, spec.table)
    for join in spec.joins:
        frame = _apply(frame, join, spec, tables, salt_hot_keys)
    return frame


def _projection(spec: ExportSpec) -> list[Column]:
    """The selected columns in order.

    A bare name is kept where it is unique; names that occur twice become
    ``<table>_<column>``.
    """
    main = spec.table.replace('"', "")
    hidden = {j.table for j in spec.joins if j.mode[1] in ("left_semi", "left_anti")}
    unfolded = {name for j in spec.joins if j.mode[0] == "array" and j.array_column for name in _array_columns(j)}
    references = [split_reference(c, main) for c in spec.columns]
    names = [column for _, column in references]
    out: list[tuple[str, Column]] = []
    taken: set[str] = set()
    for (table, column), written in zip(references, spec.columns):
        if table in hidden:
            raise ValueError(f"{written!r}: a SEMI or ANTI join keeps only the left columns")
        source = F.col(quote_name(column)) if column in unfolded and "." not in written else column_of(table, column)
        name = column if names.count(column) == 1 else f"{table}_{column}"
        # The same column chosen again is numbered.
        number = 1
        while (shown := name if number == 1 else f"{name}_{number}").lower() in taken:
            number += 1
        taken.add(shown.lower())
        out.append((shown, source))
    return [source.alias(name) for name, source in out]


def _ordering(spec: ExportSpec) -> list[Column]:
    main = spec.table.replace('"', "")
    return [column_of(*split_reference(c, main)) for c in spec.order_by]


def compile_export(spec: ExportSpec, tables: Tables) -> DataFrame:
    """Joins, projection, order and limit as one lazy plan."""
    frame = _joined(spec, tables, salt_hot_keys=False)
    if spec.counts_rows:
        return frame.agg(F.count(F.lit(1)).alias("COUNT(*)"))
    if spec.order_by:
        frame = frame.orderBy(*_ordering(spec))
    if spec.limit and spec.limit > 0:
        frame = frame.limit(spec.limit)
    return frame.select(*_projection(spec))


def export_preview(spec: ExportSpec, tables: Tables, n: int | None = None) -> DataFrame:
    """The first rows of an export; 100 unless a positive number is given."""
    frame = _joined(spec, tables, salt_hot_keys=False)
    if spec.order_by:
        frame = frame.orderBy(*_ordering(spec))
    return preview_rows(frame.select(*_projection(spec)), n)


def count_export(spec: ExportSpec, tables: Tables) -> DataFrame:
    """Rows of the joined query before limiting."""
    return _joined(spec, tables, salt_hot_keys=False).agg(F.count(F.lit(1)).alias("total_rows"))


def prepare_export(spec: ExportSpec, tables: Tables) -> DataFrame:
    """``compile_export`` for a full-size write.

    Measures outer joins for hot keys and salts them, and runs a large limit
    in parallel instead of through one task.
    """
    if spec.counts_rows:
        return compile_export(spec, tables)
    frame = _joined(spec, tables, salt_hot_keys=True)
    if not spec.joins and not spec.order_by and joins.has_row_index(frame):
        return first_rows_of_files(frame, spec.limit).select(*_projection(spec))
    # The order may use columns that are not exported, so they travel along.
    names = frame.select(*_projection(spec)).columns
    keys = {unused_name(f"order_{i}", names): key for i, key in enumerate(_ordering(spec))}
    projected = frame.select(*_projection(spec), *[key.alias(name) for name, key in keys.items()])
    if spec.limit and spec.limit > 0:
        return first_rows(projected, spec.limit, [OrderKey(name) for name in keys]).drop(*keys)
    return (spread_sort(projected, [F.col(name) for name in keys]) if keys else projected).drop(*keys)
