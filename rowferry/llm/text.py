"""Whole texts of an Arrow batch as one byte array, cut into words with numpy.

Every function works on the UTF-8 bytes, so that a chunk of many documents is
handled by a few array operations. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

_U64 = np.uint64
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = ~ASCII_SPACE
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, A-Z taken as a-z.
WORD_BYTE = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_BYTE[_low : _high + 1] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES, rows: int = 1 << 20
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch cut between rows into pieces of about ``size`` bytes of text and at most ``rows`` rows."""
    data, offsets = column_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        stop = min(max(stop, row + 1), row + rows, batch.num_rows)
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes within a row."""
    inside = word_byte[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, _U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies."""
    size = 1 << max(20, int(len(data)).bit_length())
    value = _BYTE_VALUE if fold is None else _BYTE_VALUE[fold]
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(value[data] * _powers(_STEP, size)[: len(data)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _powers(_BACK, size)[starts]
    return mix(spans + (ends - starts).astype(_U64) * _U64(0x9E3779B97F4A7C15))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive hashes (fewer rows by ``size - 1``)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, _U64)
    total = np.zeros(count, _U64)
    for k in range(size):
        total = total * _U64(_STEP) + mix(hashes[k : k + count] + _U64(k + 1))
    return mix(total + _U64(size))


def unit_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts before each ASCII space that follows something other than a space.

    A unit is a run of spaces with the word after it. No match of a pattern
    that keeps spaces in front of words crosses such a cut. After a byte that
    could end a non-ASCII space there is no cut.
    """
    space = ASCII_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    late = np.flatnonzero(cut)
    back2 = data[np.maximum(late - 2, 0)]
    back3 = data[np.maximum(late - 3, 0)]
    odd = (back2 == 0xC2) | (back3 == 0xE1) | (back3 == 0xE2) | (back3 == 0xE3)
    cut[late[odd]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)
