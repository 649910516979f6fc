"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "rowferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC on.

    On a cluster ``master``, memory and shuffle partitions come from
    spark-submit; keyword arguments (dots written as ``__``) override.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must reach it. Where none is named, it is a folder of the
    session's warehouse, which executors share as well.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_{spark.sparkContext.applicationId}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder; others may run beside it."""
    return f"{shared_folder(spark)}/rowferry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    return f"{own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again, so that nothing before is run twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Remove this application's scratch, once no plan reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_scratch(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
