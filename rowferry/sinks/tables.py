"""Tables in: create, append, load a file."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casting import typed_columns
from rowferry.functions.types import base_name, spark_type, type_name
from rowferry.operators.infer import suggested_types
from rowferry.operators.quality import ErrorBudget, bad_row, reject_rows, within_budget
from rowferry.plans.spec import LoadSpec, is_blank, quote_name
from rowferry.session import scratch_path
from rowferry.sinks.staging import Folders, stage
from rowferry.sources.delimited import read_delimited


# Result messages.
DONE = "Upload successful"
FAILED = "Error: "


@dataclass(frozen=True)
class LoadResult:
    lines: int
    success: bool
    message: str
    rejected: int = 0

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.lines, self.success, self.message)], "lines bigint, success boolean, message string"
        )


def table_id(table: str) -> str:
    """``db.table`` and already quoted names stay; other names are quoted."""
    return table if "." in table or "`" in table else quote_name(table)


def table_schema(types: Mapping[str, str | None]) -> T.StructType:
    """Declared order; blank names are skipped, blank types are text."""
    fields = [T.StructField(name, spark_type(kind)) for name, kind in types.items() if not is_blank(name)]
    if not fields:
        raise ValueError("a table needs at least one column")
    return T.StructType(fields)


def create_table(spark: SparkSession, table: str, types: Mapping[str, str | None], location: str | None = None) -> bool:
    """Create a Parquet table unless it exists; returns whether it was created."""
    if is_blank(table):
        raise ValueError("the table name must not be blank")
    schema = table_schema(types)
    if spark.catalog.tableExists(table_id(table)):
        return False
    options = {"path": location} if location else {}
    spark.catalog.createTable(table_id(table), schema=schema, source="parquet", **options)
    return True


def append_rows(df: DataFrame, table: str) -> int:
    """Append by column name; returns the rows written, counted by the write.

    Unknown columns are skipped, absent ones become NULL.
    """
    spark = df.sparkSession
    target = spark.table(table_id(table)).schema
    aligned = df.select(
        *[
            (F.col(quote_name(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )
    counted = Observation()
    aligned.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("append").insertInto(table_id(table))
    return counted.get["rows"]


def load_types(df: DataFrame, spec: LoadSpec, target: T.StructType | None) -> dict[str, str]:
    """Declared type of each file column that is loaded; a column that the file lacks is an error."""
    declared = dict(spec.column_types or {})
    chosen: Sequence[str] = spec.columns or tuple(declared) or tuple(df.columns)
    absent = [c for c in chosen if c not in df.columns]
    if absent and df.columns:
        raise ValueError(f"the file has no column {', '.join(absent)}")
    types = {}
    for column in chosen:
        if column not in df.columns:
            continue
        if declared.get(column):
            types[column] = declared[column]
        elif target is not None and column in target.names:
            types[column] = type_name(target[column].dataType)
        elif target is None:
            types[column] = "String"
    return types


def load_file(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: LoadSpec,
    rejects: str | None = None,
) -> LoadResult:
    """Load delimited files into a table: create it if asked, convert, append.

    A row is bad if a cell does not fit its type or the row has too few or too
    many cells. The load is refused if the bad rows exceed both limits, and no
    row of it is ever seen; fewer bad rows are left out, counted in
    ``rejected`` and, if a ``rejects`` path is given, kept there as text with
    the columns at fault.

    Rows are converted, counted and written in one pass, beside the table's
    files; files of a Parquet table are then renamed into it, others inserted.
    Only inferring types, and keeping rejects where there are any, read the
    text once more.
    """
    read = read_delimited(spark, path, spec.separator, spec.has_header, misfit=True)
    misfit = read.columns[-1]
    text = read.select(*[quote_name(c) for c in read.columns[:-1]])
    fits: set[str] = set()
    if spec.infer:
        chosen = text.select(*[quote_name(c) for c in spec.columns or text.columns])
        found = suggested_types(chosen)
        # Inferred types fit by construction; only declared ones are checked.
        fits = found.keys() - (spec.column_types or {}).keys()
        spec = replace(spec, column_types=found | dict(spec.column_types or {}))
    if spec.create:
        create_table(spark, spec.table, spec.column_types or dict.fromkeys(text.columns, "String"), spec.location)
    target = spark.table(table_id(spec.table)).schema
    types = load_types(text, spec, target)
    checked = {c: t for c, t in types.items() if c not in fits and base_name(t) != "String"}
    typed = dict(zip(types, typed_columns(types)))
    columns = [(typed[f.name] if f.name in typed else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields]
    folders, home = Folders(spark), plain_home(spark, spec.table)
    # Within the table's folder, files need only be renamed to be part of it.
    folder = f"{home}/_load-{uuid.uuid4().hex}" if home else scratch_path(spark, "load")
    try:
        staged = stage(read, bad_row(checked, misfit), columns, folder)
        within_budget(staged.seen, staged.bad, ErrorBudget(spec.max_bad_rows, spec.max_bad_ratio))
        if staged.bad and rejects:
            reject_rows(read, types, misfit).write.mode("append").parquet(rejects)
        if home:
            for name in folders.names(folder):
                if name.startswith("part-"):
                    folders.move(f"{folder}/{name}", f"{home}/{name}")
            spark.catalog.refreshTable(table_id(spec.table))
        else:
            spark.read.schema(target).parquet(folder).write.mode("append").insertInto(table_id(spec.table))
    finally:
        folders.drop(folder)
    return LoadResult(staged.seen - staged.bad, True, DONE, staged.bad)


def plain_home(spark: SparkSession, table: str) -> str | None:
    """The folder of a Parquet table without partitions, buckets or statistics, whose rows are those of the files there."""
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table_id(table)}").collect()}
    special = ("# Partition Information", "# Partitioning", "Num Buckets", "Bucket Columns", "Statistics")
    if (facts.get("Provider") or "").lower() != "parquet" or any(facts.get(k) for k in special) or any(k in facts for k in special):
        return None
    return facts.get("Location")


def load_outcome(spark: SparkSession, path: str | Sequence[str], spec: LoadSpec) -> LoadResult:
    """``load_file`` that reports a failure instead of raising it."""
    try:
        return load_file(spark, path, spec)
    except (PySparkException, ValueError) as error:
        return LoadResult(0, False, f"{FAILED}{error}")
