"""Product codes of vectors in whole numbers, by exact matrix products of limbs.

Components become integers floor(4096 x). They are cut into limbs so small that
a float64 product of two limbs, summed over a part, stays below 2^53: the matrix
product of each pair of limbs is exact, and the pairs' results are put together
in int64, or in Python's integers where components exceed its range. The first
least distance is the code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.session import settled

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Rows handled at once.
BLOCK = 4096
#: Bits of a limb of the sums that a round adds up; sums of 2^38 rows fit a long.
SUM_BITS = 24


def whole_vector(column: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~bad


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` float64, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) as int64, or as Python integers if a distance could leave int64."""
    bound = np.abs(values).max(initial=0.0) * SCALE + 1
    if 4 * values.shape[-1] * bound * bound < 2.0**62:
        return np.floor(values * SCALE).astype(np.int64)
    whole = [floor(x) * SCALE if abs(x) >= 2.0**53 else floor(x * SCALE) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, the lowest first; all but the highest are from 0 to 2^bits - 1."""
    out, rest, base = [], values, 1 << bits
    while len(rest.ravel()) and max(abs(int(rest.max())), abs(int(rest.min()))) >= base:
        out.append((rest % base).astype(np.float64))
        rest = rest // base
    return [*out, rest.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: float64 products of limbs, put together as whole numbers."""
    bits = (53 - max(a.shape[1] - 1, 0).bit_length()) // 2
    kind = object if object in (a.dtype, b.dtype) else np.int64
    total = np.zeros((len(a), len(b)), kind)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            part = (x @ y.T).astype(np.int64)
            total += part.astype(kind) * (1 << bits * (i + j)) if kind is object else part << bits * (i + j)
    return total


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    if object in (part.dtype, book.dtype):
        part, book = part.astype(object), book.astype(object)
    distance = (part * part).sum(1)[:, None] - 2 * exact_products(part, book) + (book * book).sum(1)[None]
    code = distance.argmin(1)
    return code, distance[np.arange(len(part)), code]


def _fitting(books: Sequence[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    """The codebooks in int64 if distances to these values fit it, else in Python's integers."""
    if values.dtype == object:
        return [b.astype(object) for b in books]
    top = max((abs(int(x)) for b in books for x in b.ravel()), default=0) + int(np.abs(values).max(initial=0)) + 1
    kind = np.int64 if values.shape[1] * top * top < 1 << 62 else object
    return [b.astype(kind) for b in books]


def _blocks(batch: pa.RecordBatch, width: int, column: str):
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(at, BLOCK)
        yield rows, scaled(padded(rows.column(column), width))


def _totals(vectors: DataFrame, column: str, width: int, books: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
    """Count and component sums of the parts nearest to each entry: {(part, entry): [count, sum, ...]}."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    size = width // PARTS

    def task(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for _, values in _blocks(batch, width, column):
                books = _fitting(shared.value, values)
                for p, book in enumerate(books):
                    part = values[:, p * size : (p + 1) * size]
                    code, _ = nearest(part, book)
                    chosen = (code[:, None] == np.arange(len(book))).astype(np.float64)
                    # A block's sums of limbs of 24 bits are exact in float64.
                    for level, limb in enumerate([np.ones((len(part), 1)), *limbs(part, SUM_BITS)]):
                        added = (chosen.T @ limb).astype(np.int64)
                        for entry in np.unique(code).tolist():
                            key = (p, entry, level)
                            sums[key] = sums[key] + added[entry] if key in sums else added[entry]
        if sums:
            part, entry, level = (pa.array([k[i] for k in sums], pa.int32()) for i in range(3))
            flat = [(k, i, int(x)) for k, v in enumerate(sums.values()) for i, x in enumerate(v)]
            row = pa.array([k for k, _, _ in flat])
            yield pa.RecordBatch.from_arrays(
                [part.take(row), entry.take(row), level.take(row), pa.array([i for _, i, _ in flat], pa.int32()), pa.array([x for _, _, x in flat], pa.int64())],
                ["part", "entry", "level", "position", "total"],
            )

    found = vectors.select(column).mapInArrow(task, "part int, entry int, level int, position int, total long")
    totals: dict[tuple[int, int], list[int]] = {}
    # At most parts x entries x limbs x positions rows, whatever the table's size.
    for r in found.groupBy("part", "entry", "level", "position").agg(F.sum("total").alias("total")).collect():
        held = totals.setdefault((r["part"], r["entry"]), [0] * (1 + size))
        if r["level"] == 0:
            held[0] = r["total"]
        else:
            held[1 + r["position"]] += r["total"] << SUM_BITS * (r["level"] - 1)
    return totals


def learn_codebooks(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (entries x components, whole numbers) of the eight parts, after ``rounds`` of assigning and averaging.

    They start from the sixteen rows with the smallest keys (null keys last;
    equal keys by their vectors), or all rows if there are fewer. An entry
    becomes the componentwise floor of its parts' average, an unused one stays.
    Vectors are filled up with zeros to the longest one's length, and to a
    multiple of eight. A round sends sums of each task only, for every entry and
    component. No rows give no codebooks.
    """
    vectors = vectors.where(whole_vector(column)).select(key, column)
    longest = vectors.agg(F.max(F.size(column))).first()[0]
    if not longest:
        return []
    width = -(-longest // PARTS) * PARTS
    first = vectors.orderBy(F.col(key).asc_nulls_last(), column).limit(ENTRIES).toArrow()
    # As Python's integers, so that sums of any size stay exact.
    values = scaled(padded(first.column(column), width)).astype(object)
    size = width // PARTS
    books = [values[:, p * size : (p + 1) * size] for p in range(PARTS)]
    for _ in range(rounds):
        for (p, entry), (count, *sums) in _totals(vectors, column, width, books).items():
            books[p][entry] = [s // count for s in sums]
    return books


def encode_vectors(vectors: DataFrame, books: list[np.ndarray], columns: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """The given columns, code (the index of the nearest entry, two hex digits a part) and error of each vector.

    Rows whose vector is null or holds null or non-finite components are
    dropped; vectors longer than the codebooks' are no input. ``error`` is the
    sum of the squared distances, null beyond the range of a long. Rows are
    coded each for itself, repeated ones alike; extra columns are left out.
    """
    width = PARTS * books[0].shape[1] if books else 0
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def task(batches):
        digits = np.array([f"{i:02x}" for i in range(max(ENTRIES, 256))])
        for batch in batches:
            for rows, values in _blocks(batch, width, column):
                code, error = np.zeros((rows.num_rows, PARTS), np.int64), 0
                for p, book in enumerate(_fitting(shared.value, values)):
                    code[:, p], distance = nearest(values[:, p * width // PARTS : (p + 1) * width // PARTS], book)
                    error = error + distance
                text = np.ascontiguousarray(digits[code]).view(f"<U{2 * PARTS}").ravel()
                if error.dtype == object:
                    error = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in columns), pa.array(text.tolist(), pa.string()), pa.array(error, pa.int64())], [*columns, "code", "error"]
                )

    kept = vectors.where(whole_vector(column) if books else F.lit(False)).select(*dict.fromkeys([*columns, column]))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(task, f"{kinds}, code string, error long")


def codebooks_digest(books: list[np.ndarray]) -> str:
    """sha256 of the entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def code_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every whole vector.

    ``label_error`` is the error of all rows of the label (null labels are one),
    null beyond the range of a long. Codes are written to the shared folder
    before they are added up, so that they are made once. Empty tables give no rows.
    """
    books = learn_codebooks(vectors, key, column)
    names = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(column).alias("vector"))
    coded = settled(encode_vectors(names, books, ("key", "label"), "vector"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
