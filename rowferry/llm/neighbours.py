"""Nearest vectors by a permutation index.

A vector is represented by its nearest pivots in their order, and posted in the
lists of the first few of them. A query goes to the lists of its own nearest
pivots. There the footrule distance between the orders ranks what is posted, and
only the best are compared with the query by inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.llm.vector_codes import padded, whole_vector
from rowferry.session import settled

#: Pivots: half the root of the distinct vectors, within these bounds.
PIVOTS = (32, 4096)
#: Pivots compared by the footrule distance.
PREFIX = 64
#: Lists that a vector is posted in.
HOMES = 2
#: Lists that a query visits, times the root of the pivots.
VISITS = 5
#: Share of a list's candidates that are compared by inner product, times the root of the distinct vectors, and their least number.
COMPARED, LEAST = 40, 64
#: Rows of a piece of a list, and queries that meet it in one group.
PIECE, MEETING = 8192, 2048
#: Two possible pivots of a larger cosine are near copies; the later one is left out.
COPY = 0.98


@dataclass(frozen=True)
class Index:
    """What every task needs of the index; its size is bounded by the number of pivots."""

    pivots: np.ndarray  # pivots x components, without the added one
    heights: np.ndarray  # the pivots' added components
    longest: float  # squared length that all vectors have with the added component
    vectors: int  # distinct vectors

    @property
    def visits(self) -> int:
        return min(len(self.pivots), ceil(VISITS * sqrt(len(self.pivots))))

    def orders(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The nearest pivots of each vector, nearest first, ties to the earlier pivot: a query's lists, else a prefix.

        With an added component all vectors are equally long, so that nearness
        to a query, which has 0 there, is the inner product.
        """
        nearness = vectors @ self.pivots.T
        if not query:
            missing = np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", vectors, vectors), 0))
            nearness += missing[:, None] * self.heights
        size = max(PREFIX, self.visits) if query else PREFIX
        return np.argsort(-nearness, axis=1, kind="stable")[:, :size].astype(np.int32)


def _marked(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that take part: id, vector and its mark. Two 64-bit hashes tell vectors apart."""
    usable = whole_vector(column) & F.exists(column, lambda x: x != 0) & F.col(key).isNotNull()
    rows = vectors.where(usable).select(F.col(key).alias("id"), F.col(column).alias("vector"))
    return rows.withColumn("mark", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b")))


def _distinct(rows: DataFrame, ids: int) -> DataFrame:
    """Each distinct vector with the ``ids`` smallest of its ids."""
    rank = F.row_number().over(Window.partitionBy("mark").orderBy("id"))
    least = rows.select("mark", "id").distinct().withColumn("rank", rank).where(F.col("rank") <= ids)
    listed = least.groupBy("mark").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("mark").agg(F.first("vector").alias("vector"))
    return vectors.join(listed, "mark")


def build_index(entries: DataFrame) -> Index | None:
    """Pivots from a bounded sample: those of the least hashes, near copies of earlier ones left out."""
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, longest, width = entries.agg(F.count("*"), F.max(squared), F.max(F.size("vector"))).first()
    if not count:
        return None
    wanted = min(max(PIVOTS[0], ceil(sqrt(count) / 2)), PIVOTS[1])
    drawn = entries.orderBy(F.xxhash64("mark.a", F.lit(7)), "mark").limit(2 * wanted).select("vector").toArrow()
    sample = padded(drawn.column("vector"), width)
    unit = sample / np.sqrt(np.einsum("ij,ij->i", sample, sample))[:, None]
    kept: list[int] = []
    for k in range(len(unit)):
        if len(kept) < wanted and not (unit[kept] @ unit[k] > COPY).any():
            kept.append(k)
    pivots = sample[kept]
    heights = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", pivots, pivots), 0))
    return Index(pivots, heights, longest, count)


def _with_lists(rows: DataFrame, index, query: bool) -> DataFrame:
    """Rows with the lists that they are posted in, or visit."""
    schema = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        size = found.visits if query else min(HOMES, len(found.pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = found.orders(padded(part.column("vector"), found.pivots.shape[1]), query)[:, :size]
                cuts = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, pa.array(lists.ravel()))], schema.names)

    return rows.mapInArrow(task, schema)


def _sizes(rows: DataFrame, name: str, piece: int) -> DataFrame:
    """How many pieces of at most about ``piece`` rows each list has; one row a list."""
    lists = rows.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    return lists.select("list", F.ceil(F.col("n") / piece).cast("int").alias(name))


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """A row for each list, in one of its own side's pieces, met by all of the other side's."""
    rows = rows.withColumn("list", F.explode("lists")).drop("lists").join(F.broadcast(sizes), "list")
    rows = rows.withColumn(own, F.pmod(F.xxhash64("mark", "list"), F.col(own)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def _meet(index: Index, k: int, number: int, posted: pa.Table, queries: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the nearest of a list's piece, by footrule distance and then by inner product."""
    width, size = index.pivots.shape[1], min(PREFIX, len(index.pivots))
    points, asked = padded(posted.column("vector"), width), padded(queries.column("vector"), width)
    orders, orders_asked = index.orders(points, False), index.orders(asked, True)
    # Places counted from the far end, 0 for pivots beyond the prefix: the footrule distance
    # falls by two for each one more in the sum of the lesser of two places.
    place = np.arange(size, 0, -1, dtype=np.uint8)
    places = np.zeros((len(index.pivots), len(points)), np.uint8)
    places[orders, np.arange(len(points))[:, None]] = place
    homes = orders[:, : min(HOMES, size)]
    share = min(1.0, COMPARED / sqrt(index.vectors))
    ids = posted.column("ids").combine_chunks()
    id_cuts, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
    unvisited = np.full(len(index.pivots), len(index.pivots))
    for q, whole in enumerate(orders_asked):
        rank, order = unvisited.copy(), whole[:size]
        rank[whole[: index.visits]] = np.arange(index.visits)
        # Who is in several visited lists is met in the first of them.
        here = np.flatnonzero(rank[homes].min(1) == rank[number])
        if not len(here):
            continue
        common = np.minimum(places[order][:, here], place[:, None]).sum(0, dtype=np.int32)
        few = max(LEAST, ceil(share * len(here)))
        if len(here) > few:
            here = here[np.argsort(-common, kind="stable")[:few]]
        score = np.einsum("ij,j->i", points[here], asked[q])
        best = here[np.lexsort((flat[id_cuts[here]], -score))[:k]]
        counts = id_cuts[best + 1] - id_cuts[best]
        owner = np.repeat(best, counts)
        own = flat[np.arange(len(owner)) + np.repeat(id_cuts[best] - np.cumsum(counts) + counts, counts)]
        exact = np.einsum("ij,j->i", points[owner], asked[q])
        first = np.lexsort((own, -exact))[:k]
        yield q, own[first], exact[first]


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest rows found for each row where ``is_query`` holds.

    Nearest is the largest inner product, in double precision, ties going to
    the smaller id; a query's own id is no candidate. Every row is indexed.
    Which candidates are compared is decided by the index, so that a few of
    the true nearest may be missed; scores are exact.

    Rows without an id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part. Shorter vectors are filled up with
    zeros. Equal vectors are one entry of the index, with as many ids as a
    result can name; queries of equal vectors are searched once. Rows repeated
    whole count once; an id with several vectors counts with each. Extra
    columns are left out. Empty tables give no rows.

    Lists and their visitors are cut into pieces, so that no group grows with
    the table, however many vectors have the same nearest pivot.
    """
    spark = vectors.sparkSession
    rows = _marked(vectors, key, column)
    asked = _marked(vectors.where(is_query), key, column)
    entries = settled(_distinct(rows, k + 1), "vectors")
    built = build_index(entries)
    result = "query_id long, rank int, vec_id long, score double"
    if built is None:
        return spark.createDataFrame([], result)
    index = spark.sparkContext.broadcast(built)
    posted = settled(_with_lists(entries, index, False), "posted")
    queries = settled(_with_lists(asked.groupBy("mark").agg(F.first("vector").alias("vector")), index, True), "queries")
    # One row a list, of which there are as many as pivots.
    sizes = settled(_sizes(posted, "piece", PIECE).join(_sizes(queries, "meeting", MEETING), "list"), "sizes")

    def meet(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number = group[0].as_py()
        # Rows come in any order; by their marks a rerun meets them in the same one.
        left, right = (t.flatten().sort_by([("mark.a", "ascending"), ("mark.b", "ascending")]) for t in (left, right))
        found = list(_meet(index.value, k + 1, number, left, right)) if left.num_rows and right.num_rows else []
        query = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(i) for _, i, _ in found])
        ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
        return pa.table(
            {"a": right.column("mark.a").combine_chunks().take(pa.array(query)), "b": right.column("mark.b").combine_chunks().take(pa.array(query)), "id": ids, "score": scores}
        )

    keys = ("list", "piece", "meeting")
    left, right = _dealt(posted, sizes, "piece", "meeting"), _dealt(queries, sizes, "meeting", "piece")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "a long, b long, id long, score double")
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = found.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    own = asked.select(F.col("id").alias("query_id"), "mark.a", "mark.b").distinct()
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = own.join(listed, ["a", "b"]).select("query_id", F.posexplode(others).alias("pos", "of"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("of.id").alias("vec_id"), "of.score")
