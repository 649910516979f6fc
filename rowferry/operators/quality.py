"""Rows that do not fit their declared types."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.casting import cast_text, is_rejected
from rowferry.functions.types import base_name
from rowferry.plans.spec import MAX_BAD_RATIO, MAX_BAD_ROWS, quote_name, unused_name


class TooManyBadRows(ValueError):
    """Both limits on bad rows are exceeded."""


# What stands among the columns at fault for a row with too few or too many cells.
WIDTH = "(width)"


def bad_row(types: Mapping[str, str], misfit: str | None = None) -> Column:
    """True if any cell of the row does not fit its declared type, or the row has the wrong width."""
    checks = [is_rejected(F.col(quote_name(c)), t) for c, t in types.items() if base_name(t) != "String"]
    if misfit:
        checks.append(F.col(quote_name(misfit)))
    return reduce(lambda a, b: a | b, checks) if checks else F.lit(False)


def good_rows(df: DataFrame, types: Mapping[str, str], misfit: str | None = None) -> DataFrame:
    """The rows that fit, converted."""
    typed = [cast_text(F.col(quote_name(c)), t).alias(c) for c, t in types.items()]
    return df.where(~bad_row(types, misfit)).select(*typed)


def reject_rows(df: DataFrame, types: Mapping[str, str], misfit: str | None = None) -> DataFrame:
    """The rows that do not fit, as text, with the names of the columns at fault."""
    faults = [F.when(is_rejected(F.col(quote_name(c)), t), F.lit(c)) for c, t in types.items()]
    if misfit:
        faults.append(F.when(F.col(quote_name(misfit)), F.lit(WIDTH)))
    kept = [F.col(quote_name(c)) for c in df.columns if c != misfit]
    at_fault = F.array_join(F.array_compact(F.array(*faults)), ",")
    return df.where(bad_row(types, misfit)).select(*kept, at_fault.alias(unused_name("bad_columns", df.columns)))


def validate_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``(column_name, type_name, value_count, bad_count)`` before a load, in one pass."""
    stats = df.agg(
        *[
            F.struct(
                F.count_if(F.length(F.col(quote_name(c))) > 0).alias("value_count"),
                F.count_if(is_rejected(F.col(quote_name(c)), t)).alias("bad_count"),
            ).alias(c)
            for c, t in types.items()
        ]
    )
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    rows = stats.unpivot([], [F.col(quote_name(c)) for c in types], "column_name", "s")
    return rows.select("column_name", names[F.col("column_name")].alias("type_name"), "s.value_count", "s.bad_count")


@dataclass(frozen=True)
class ErrorBudget:
    """A load fails only if the bad rows exceed the number and the ratio."""

    max_rows: int = MAX_BAD_ROWS
    max_ratio: float = MAX_BAD_RATIO

    def exceeded(self, rows: Column, bad: Column) -> Column:
        return (bad > F.lit(self.max_rows)) & (bad > rows * F.lit(self.max_ratio))


def error_budget(df: DataFrame, types: Mapping[str, str], budget: ErrorBudget = ErrorBudget(), misfit: str | None = None) -> DataFrame:
    """One row ``(row_count, bad_count, within_budget)``."""
    found = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(bad_row(types, misfit)).alias("bad_count"))
    return found.select("*", (~budget.exceeded(F.col("row_count"), F.col("bad_count"))).alias("within_budget"))


def check_budget(
    df: DataFrame, types: Mapping[str, str], budget: ErrorBudget = ErrorBudget(), misfit: str | None = None
) -> tuple[int, int]:
    """(rows, bad rows); raises if the budget is exceeded."""
    found = error_budget(df, types, budget, misfit).head()
    within_budget(found.row_count, found.bad_count, budget)
    return found.row_count, found.bad_count


def within_budget(rows: int, bad: int, budget: ErrorBudget) -> None:
    """Raises if the bad rows exceed both limits."""
    if bad > budget.max_rows and bad > rows * budget.max_ratio:
        raise TooManyBadRows(f"{bad} of {rows} rows do not fit their types")
