"""Rows written once beside their place, and shown there or dropped when they are counted.

The write observes how many rows it saw and how many of them were bad, so that a
load reads its text once. What it wrote lies in a folder that readers pass
over, until its files are moved or its folder is entered in a ledger.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowferry.plans.spec import unused_name

LEDGER = "_ledger"


class Folders:
    """The few steps on folders that a load takes, on whatever file system they are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, spark._jvm.org.apache.hadoop.fs.Path

    def system(self, folder: str):
        return self.path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        system = self.system(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(self.path(folder))) if system.exists(self.path(folder)) else []

    def move(self, source: str, target: str) -> None:
        if not self.system(source).rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def make(self, folder: str) -> None:
        self.system(folder).mkdirs(self.path(folder))

    def drop(self, folder: str) -> None:
        self.system(folder).delete(self.path(folder), True)

    def note(self, file: str, text: str) -> None:
        """Write a small file that is there as a whole or not at all; one that is there stays."""
        beside = f"{file.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.system(file).create(self.path(beside))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.system(file).exists(self.path(file)):
            self.move(beside, file)
        else:
            self.drop(beside)

    def read(self, file: str) -> str:
        stream = self.system(file).open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


@dataclass(frozen=True)
class Staged:
    """Rows written to ``folder``: how many were seen, and how many of them were bad."""

    folder: str
    seen: int
    bad: int


def stage(rows: DataFrame, bad: Column, columns: list[Column], folder: str, keep_bad: bool = False) -> Staged:
    """Write the columns of the rows, without the bad ones unless they are kept, in one pass over them."""
    counted = Observation()
    flag = unused_name("bad", rows.columns)
    seen = rows.withColumn(flag, F.coalesce(bad, F.lit(False)))
    seen = seen.observe(counted, F.count(F.lit(1)).alias("seen"), F.count_if(flag).alias("bad"))
    (seen if keep_bad else seen.where(~F.col(flag))).select(*columns).write.parquet(folder)
    return Staged(folder, counted.get["seen"], counted.get["bad"])


def enter(spark: SparkSession, target: str, name: str, folder: str) -> None:
    """Make a folder beside ``target``'s ledger the one that counts under ``name``, unless there is one already."""
    folders = Folders(spark)
    folders.make(f"{target}/{LEDGER}")
    folders.note(f"{target}/{LEDGER}/{name}", folder)


def entered(spark: SparkSession, target: str) -> dict[str, str]:
    """The folders that count, by name."""
    folders = Folders(spark)
    return {n: f"{target}/{folders.read(f'{target}/{LEDGER}/{n}')}" for n in folders.names(f"{target}/{LEDGER}") if not n.startswith(".")}
