"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words the smallest hash of ``GRAM`` words is
kept, the rightmost one of equals. Two texts that share ``WINDOW`` words keep
the same gram of them, so joining the kept grams of documents and benchmark
items finds every shared span of that length; each hit is then extended word
by word in both directions, which also drops false hits. An item shorter than
``WINDOW`` words is looked up as one gram of its own length.

A benchmark whose texts measure at most ``MAX_LOCAL_BYTES`` is sent to every
task. A larger one is joined in Spark: kept grams by hash, which yields the
candidate items of a document, then their texts, one (document, item) pair a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from rowferry.llm.text import LOWER, WORD_BYTE, chunks, column_bytes, gram_hashes, hash_spans, words

WINDOW = 10
GRAM = 5
#: Measured size of benchmark texts up to which they are sent to every task.
MAX_LOCAL_BYTES = 16 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word."""
    starts, ends, row = words(data, offsets, WORD_BYTE)
    return hash_spans(data, starts, ends, LOWER), row


def whole_grams(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams within one row, and the positions they start at."""
    grams = gram_hashes(hashes, size)
    at = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    return grams[at], at


def winnow(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept grams of all windows, and the positions they start at."""
    grams = gram_hashes(hashes, GRAM)
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, at = grams[:count].copy(), np.arange(count)
    for k in range(1, WINDOW - GRAM + 1):
        other = grams[k : k + count]
        later = other <= least
        np.copyto(least, other, where=later)
        at[later] = np.flatnonzero(later) + k
    kept = np.unique(at[row[:count] == row[WINDOW - 1 : WINDOW - 1 + count]])
    return grams[kept], kept


@dataclass(frozen=True)
class Items:
    """The words of some benchmark items and the grams that lead to them."""

    hashes: np.ndarray
    item: np.ndarray
    #: Gram length -> sorted gram hashes and the word positions they start at; GRAM, 0 holds kept grams.
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    length: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Items:
        hashes, item = word_hashes(data, offsets)
        length = np.bincount(item, minlength=len(offsets) - 1)
        long = length[item] >= WINDOW
        found = {}
        kept, at = winnow(hashes, item)
        found[GRAM, 0] = (kept, at)
        for size in np.unique(length[(length > 0) & (length < WINDOW)]).tolist():
            grams, at = whole_grams(hashes, item, size)
            own = ~long[at] & (length[item[at]] == size)
            found[size, 1] = (grams[own], at[own])
        ordered = {}
        for key, (grams, at) in found.items():
            order = np.argsort(grams, kind="stable")
            ordered[key] = (grams[order], at[order])
        return Items(hashes, item, ordered, length)

    def lookup(self, key: tuple[int, int], grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (document position, item position) of equal grams."""
        own, own_at = self.grams[key]
        if not len(own) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[own & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(seen[grams & np.uint64(0xFFFF)])
        low = np.searchsorted(own, grams[maybe], "left")
        count = np.searchsorted(own, grams[maybe], "right") - low
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at[maybe], count), own_at[np.repeat(low, count) + within]


def runs(items: Items, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows of (document row, item, start, end) of all spans that hold a window, in words of the chunk."""
    found = []
    for key in items.grams:
        grams, at = winnow(hashes, row) if key[1] == 0 else whole_grams(hashes, row, key[0])
        p, q = items.lookup(key, grams, at)
        if not len(p):
            continue
        start, end = p.copy(), p + 1
        for step, edge in ((-1, start), (1, end)):
            live = np.arange(len(p))
            while len(live):
                own = edge[live] - (step < 0)
                other = own - p[live] + q[live]
                same = (own >= 0) & (own < len(hashes)) & (other >= 0) & (other < len(items.hashes))
                live, own, other = live[same], own[same], other[same]
                same = (hashes[own] == items.hashes[other]) & (row[own] == row[p[live]]) & (items.item[other] == items.item[q[live]])
                live = live[same]
                edge[live] += step
        item = items.item[q]
        long = end - start >= np.minimum(WINDOW, items.length[item])
        found.append(np.stack([row[p], item, start, end], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)


def hit_columns(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Words, hit words, and hits (item, start, end in words of the row) of each row of a chunk."""
    hashes, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    n_words = np.bincount(row, minlength=rows)
    first = np.cumsum(n_words) - n_words
    found = runs(items, hashes, row)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, found[:, 2], 1)
    np.add.at(cover, found[:, 3], -1)
    n_hit = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    cuts = np.searchsorted(found[:, 0], np.arange(rows + 1)).astype(np.int32)
    base = first[found[:, 0]]
    entries = pa.StructArray.from_arrays(
        [pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2] - base), pa.array(found[:, 3] - base)],
        ["item", "start", "end"],
    )
    return [pa.array(n_words), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(cuts), entries)]


def find_hits(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("doc_id",), max_local_bytes: int = MAX_LOCAL_BYTES) -> DataFrame:
    """Per document: the given columns, n_words, n_hit, and hits (item_id, start, end in words).

    ``items`` has item_id and text. A null text has no words and no item
    without words is ever found; repeated rows on either side are handled each
    for itself, a null item_id is reported as null. Item ids keep their type,
    whatever the size of the benchmark; a document's text may be of any length.
    Other columns are left out.
    """
    items = items.select("item_id", "text")
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 16 * size[1] <= max_local_bytes:
        rows = items.collect()
        data, offsets = column_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
        shared = docs.sparkSession.sparkContext.broadcast((Items.of(data, offsets), [r["item_id"] for r in rows]))
        return _against(docs, shared, columns, items.schema["item_id"].dataType)
    return _joined(docs, items, columns)


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _schema(frame: DataFrame, columns: tuple[str, ...], item: str) -> str:
    return ", ".join([*(f"`{c}` {_kind(frame, c)}" for c in columns), f"n_words long, n_hit long, hits array<struct<item_id:{item},start:long,end:long>>"])


def _against(docs: DataFrame, shared, columns: tuple[str, ...], item_type: DataType) -> DataFrame:
    arrow_type = to_arrow_type(item_type)

    def task(batches):
        items, ids = shared.value
        ids = pa.array(ids, arrow_type)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                n_words, n_hit, hits = hit_columns(items, data, offsets)
                fields = hits.values.flatten()
                named = pa.StructArray.from_arrays([ids.take(fields[0]), fields[1], fields[2]], ["item_id", "start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), n_words, n_hit, pa.ListArray.from_arrays(hits.offsets, named)],
                    [*columns, "n_words", "n_hit", "hits"],
                )

    return docs.mapInArrow(task, _schema(docs, columns, item_type.simpleString()))


def _gram_sizes(items: DataFrame) -> list[int]:
    """The lengths under a window that items have, and 0 if one is longer: at most ten numbers."""

    def task(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                length = np.bincount(words(data, offsets, WORD_BYTE)[2], minlength=part.num_rows)
                sizes = np.unique(np.where(length < WINDOW, length, 0)[length > 0])
                yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32))], ["size"])

    return sorted(r["size"] for r in items.select("text").mapInArrow(task, "size int").distinct().collect())


def _kept_grams(rows: DataFrame, own_length: bool, sizes: list[int]) -> DataFrame:
    """Distinct (size, gram, key) of all rows, of the sizes given; size 0 stands for the kept grams of windows."""

    def task(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                hashes, row = word_hashes(data, offsets)
                length = np.bincount(row, minlength=part.num_rows)
                for size in sizes:
                    grams, at = winnow(hashes, row) if size == 0 else whole_grams(hashes, row, size)
                    if own_length and size:
                        own = length[row[at]] == size
                        grams, at = grams[own], at[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), size, np.int32)), pa.array(grams.view(np.int64)), part.column("key").take(pa.array(row[at]))],
                        ["size", "gram", "key"],
                    )

    return rows.mapInArrow(task, f"size int, gram long, key {_kind(rows, 'key')}").distinct()


def _joined(docs: DataFrame, items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size; documents go by a digest of their text."""
    rows = docs.select(F.struct(*columns).alias("columns"), "text", F.sha2("text", 256).alias("digest"))
    texts = rows.select("digest", "text").where("text IS NOT NULL").dropDuplicates(["digest"])
    keyed = items.select(F.col("item_id").alias("key"), "text")
    sizes = _gram_sizes(items)
    found = _kept_grams(texts.withColumnRenamed("digest", "key"), False, sizes).withColumnRenamed("key", "digest")
    candidates = found.join(_kept_grams(keyed, True, sizes).withColumnRenamed("key", "item_id"), ["size", "gram"]).select("digest", "item_id").distinct()
    i = items.withColumnRenamed("text", "item_text").alias("i")
    pairs = (
        candidates.join(texts, "digest").alias("p").join(i, F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("p.digest", "p.text", "p.item_id", "item_text")
    )

    def task(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                item_data, item_offsets = column_bytes(part.column("item_text"))
                hits = []
                for k in range(part.num_rows):
                    own = Items.of(item_data[item_offsets[k] : item_offsets[k + 1]], np.array([0, item_offsets[k + 1] - item_offsets[k]]))
                    hits.append(hit_columns(own, data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[2])
                spans = pa.chunked_array(hits).combine_chunks()
                fields = spans.values.flatten()
                pair = pa.StructArray.from_arrays([fields[1], fields[2]], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("item_id"), pa.ListArray.from_arrays(spans.offsets, pair)], ["digest", "item_id", "spans"]
                )

    item = _kind(items, "item_id")
    spans = pairs.mapInArrow(task, f"digest string, item_id {item}, spans array<struct<start:long,end:long>>")
    hits = (
        spans.select("digest", "item_id", F.explode("spans").alias("s"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("item_id"), F.col("s.start"), F.col("s.end")))).alias("hits"))
    )

    def counted(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                n_words = np.bincount(words(data, offsets, WORD_BYTE)[2], minlength=part.num_rows)
                n_hit = []
                for k, spans in enumerate(part.column("hits").to_pylist()):
                    hit = np.zeros(int(n_words[k]), bool)
                    for s in spans:
                        hit[s["start"] : s["end"]] = True
                    n_hit.append(int(hit.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("columns"), pa.array(n_words), pa.array(n_hit, pa.int64()), part.column("hits")], ["columns", "n_words", "n_hit", "hits"]
                )

    joined = rows.join(hits, "digest", "left").select("columns", "text", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))
    return joined.mapInArrow(counted, _schema(joined, ("columns",), item)).select("columns.*", "n_words", "n_hit", "hits")
