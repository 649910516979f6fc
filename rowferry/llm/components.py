"""Connected components of links, and tables and broadcasts that are dropped when no step needs them any more."""

from __future__ import annotations

from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.session import scratch_path
from rowferry.sinks.staging import Folders


#: Bytes of rows that Spark hands to a Python task at once; each side of the pipe holds such a batch a few times.
BATCH_BYTES = "4m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Links that a task joins at once, 4 MB of them. No more than these need no rounds.
PART = 1 << 18


@contextmanager
def small_batches(spark: SparkSession):
    """Plans that run inside hand about BATCH_BYTES to a task at once, or one row if it is larger."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


class Scratch:
    """Tables in the shared folder, each until it is dropped, and values that tasks know until they are forgotten."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, Folders(spark)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.known: list[Broadcast] = []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """The rows written and read again, so that nothing before is run twice."""
        path = scratch_path(self.spark, label)
        with small_batches(self.spark):
            df.write.parquet(path)
        settled = self.spark.read.parquet(path)
        self.paths[id(settled)] = (settled, path)
        return settled

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no plan still to be run reads; frames of other origin stay."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                self.folders.drop(path)

    def share(self, value) -> Broadcast:
        """The value for all tasks until ``forget``."""
        self.known.append(self.spark.sparkContext.broadcast(value))
        return self.known[-1]

    def forget(self) -> None:
        """Free what was shared, on the driver and the executors; only for plans whose rows are settled."""
        while self.known:
            self.known.pop().destroy()


def _to_least(edges: DataFrame) -> DataFrame:
    """Every node with the least of itself and its neighbours, beside each neighbour."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and the smallest node that each is joined to, itself included."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(least[u], least[v]), np.maximum(least[u], least[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(least, high[apart], low[apart])
        while (further := least[least]).tobytes() != least.tobytes():
            least = further
    return nodes, nodes[least]


def _joined(links: DataFrame) -> DataFrame:
    """(node, component) of links (u, v), as far as PART links of a task tell; a node may have several of these rows."""

    def task(batches):
        def told():
            u, v = (np.concatenate(side) for side in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(u, v)], ["node", "component"])

        held = []
        for batch in batches:
            held.append([batch.column(side).to_numpy() for side in ("u", "v")])
            if sum(len(u) for u, _ in held) >= PART:
                yield told()
                held = []
        if held:
            yield told()

    return links.mapInArrow(task, "node long, component long")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for the nodes of links (a, b), longs; the component is its smallest node.

    Tasks join the links of their parts. If there are more parts than one,
    alternating star contraction follows: larger neighbours, then smaller ones
    and the node itself, are linked to the least neighbour until nothing
    changes. No links give no rows; self links and repeated links are ignored.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.settle(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v"), "links")
    parts = ceil(edges.count() / PART)
    if parts < 2:
        return _joined(edges.coalesce(1))
    before, edges = edges, scratch.settle(_joined(edges.coalesce(parts)).where("node <> component").toDF("u", "v"), "links")
    scratch.drop(before)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _to_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        before, edges = edges, scratch.settle(small.where("u <> v").distinct(), "links")
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, component) after more links (a, b): only links between components are looked at, as links of these."""
    ends = links
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        ends = ends.join(known, side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
    joined = scratch.settle(components(ends.where("a <> b"), scratch), "joined")
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    # A component keeps the name of its smallest node, so that unlabelled nodes are the rest of the names.
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
    found = scratch.settle(old.unionByName(new), "labels")
    scratch.drop(joined)
    return found
