"""Load many files in batches, go on where the last run stopped, report progress."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rowferry.functions.casting import typed_columns
from rowferry.operators.quality import ErrorBudget, TooManyBadRows, bad_row, reject_rows, within_budget
from rowferry.sinks.staging import Folders, enter, entered, stage
from rowferry.sources.delimited import read_delimited
from rowferry.sources.records import literal_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
STEP_SCHEMA = "batch bigint, rows_read bigint, rows_loaded bigint, bytes_read bigint, seconds double"


def stream_load(
    spark: SparkSession,
    folder: str,
    types: Mapping[str, str],
    target: str,
    checkpoint: str,
    sep: str = ",",
    header: bool = True,
    files_per_batch: int | None = None,
    keep_bad_rows: bool = False,
    rejects: str | None = None,
    budget: ErrorBudget = ErrorBudget(),
) -> StreamingQuery:
    """Load all files not loaded yet into Parquet at ``target`` and stop.

    Files are read like any delimited files: columns go by the names in each
    header (without one, by position), cells may span lines, a declared column
    that no file of a batch has is an error. Rows that do not fit their types
    or have the wrong width are left out, and kept as text under ``rejects`` if
    given; a batch with more of them than the budget allows fails the load
    before anything of it is written. ``keep_bad_rows`` keeps them with NULLs.

    ``checkpoint`` records what was loaded: a rerun takes only new files. Every
    attempt at a batch writes a folder of its own, in one pass over the text (a
    second one keeps the rejects, where there are any). One entry in a ledger
    makes it count; the first attempt entered stays, so that readers, who go by
    the ledger (``loaded_rows``), never meet a folder that is being written.
    Without ``files_per_batch`` the paths of all new files are on the driver.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if files_per_batch:
        files = files.option("maxFilesPerTrigger", files_per_batch)

    def load(batch: DataFrame, number: int) -> None:
        began = time.time()
        found = batch.collect()
        paths, size = [literal_path(r.path) for r in found], sum(r.length for r in found)
        if not paths:
            return
        session = batch.sparkSession
        text = read_delimited(session, paths, sep, header, misfit=True)
        if not header:
            text = text.toDF(*list(types)[: len(text.columns) - 1], *text.columns[len(types) : -1], text.columns[-1])
        misfit = text.columns[-1]
        absent = [c for c in types if c not in text.columns[:-1]]
        if absent and len(text.columns) > 1:
            raise ValueError(f"the files have no column {', '.join(absent)}")
        if absent:
            return
        attempt, name = f"batch-{number}-{uuid.uuid4().hex}", f"batch-{number}"
        staged = stage(text, bad_row(types, misfit), typed_columns(types), f"{target}/{attempt}", keep_bad_rows)
        bad = 0 if keep_bad_rows else staged.bad
        try:
            within_budget(staged.seen, bad, budget)
        except TooManyBadRows:
            folders = Folders(session)
            folders.drop(staged.folder)
            if not folders.names(target):
                folders.drop(target)
            raise
        if rejects and bad:
            reject_rows(text, types, misfit).write.parquet(f"{rejects}/{attempt}")
            enter(session, rejects, name, attempt)
        enter(session, target, name, attempt)
        step = (number, staged.seen, staged.seen - bad, size, time.time() - began)
        session.createDataFrame([step], STEP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/progress/{name}")

    paths = files.load(folder).select("path", "length")
    query = paths.writeStream.foreachBatch(load).option("checkpointLocation", f"{checkpoint}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def loaded_rows(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all batches under ``target`` (or under a folder of rejects), as its ledger names them."""
    folders = entered(spark, target)
    if not folders:
        raise ValueError(f"nothing was loaded to {target}")
    return spark.read.parquet(*folders.values())


def progress_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per batch of a load: rows and bytes, in the batch and so far, and speed."""
    steps = spark.read.schema(STEP_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{checkpoint}/progress")
    so_far = Window.orderBy("batch")
    return steps.select(
        "batch",
        "rows_read",
        "rows_loaded",
        "bytes_read",
        F.sum("rows_loaded").over(so_far).alias("rows_so_far"),
        F.sum("bytes_read").over(so_far).alias("bytes_so_far"),
        (F.col("rows_read") / F.col("seconds")).alias("rows_per_second"),
    )
