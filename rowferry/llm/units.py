"""Token ids of whole texts, encoding each distinct piece between spaces once.

A text is cut before spaces (`unit_offsets`), a batch's pieces are numbered by
Arrow's dictionary encoding, and only pieces not met before are encoded. A
worker remembers a bounded number of pieces from task to task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowferry.llm.text import unit_offsets

#: Pieces that a worker remembers in each of two generations, and their longest length in bytes.
CACHED = 250_000
CACHED_BYTES = 64

_encoders: list = []


def kept_encoder(size: int):
    """Like ``lru_cache``, for functions that make encoders; what they know lasts until ``release_encoders``."""

    def keep(make: Callable) -> Callable:
        _encoders.append(lru_cache(maxsize=size)(make))
        return _encoders[-1]

    return keep


def release_encoders() -> None:
    """Free what this worker knows of pieces, for tasks that encode nothing: workers live on from query to query.

    Arrow's own spare memory goes with it.
    """
    if any(encoder.cache_info().currsize for encoder in _encoders):
        for encoder in _encoders:
            encoder.cache_clear()
        pa.default_memory_pool().release_unused()


class Remembered:
    """Ids of pieces, as bytes of int32. The older of two generations goes when the younger is full."""

    def __init__(self, size: int = CACHED):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, piece):
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self.young[piece] = found
        return found

    def get_all(self, pieces: list) -> list:
        """Ids of each piece, None for those not known."""
        found = list(map(self.young.get, pieces))
        if self.old:
            for k in [k for k, ids in enumerate(found) if ids is None]:
                ids = self.old.get(pieces[k])
                if ids is not None:
                    found[k] = self.young[pieces[k]] = ids
        return found

    def put(self, piece, ids: bytes) -> None:
        if len(piece) <= CACHED_BYTES:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[piece] = ids

    def put_all(self, pieces: list, ids: list) -> None:
        """The same for many pieces, none of them known."""
        short = [len(x) <= CACHED_BYTES for x in pieces]
        if not all(short):
            pieces, ids = list(compress(pieces, short)), list(compress(ids, short))
        begin = 0
        while begin < len(pieces):
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            end = begin + self.size - len(self.young)
            self.young.update(zip(pieces[begin:end], ids[begin:end]))
            begin = end


class Filled(dict):
    """Ids of pieces like ``Remembered``, made by ``make`` for a piece that is asked for and not known."""

    def __init__(self, make: Callable, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class UnitEncoder:
    """Ids of rows of a chunk; ``encode`` maps a list of byte strings to their ids as bytes of int32."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        self.encode = encode
        self.known = Remembered()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of each row among them."""
        cuts = unit_offsets(data, offsets)
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(units)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy()
        del units, coded
        ids = self.known.get_all(distinct)
        new = [k for k, x in enumerate(ids) if x is None]
        pieces = [distinct[k] for k in new]
        made = self.encode(pieces)
        for k, found in zip(new, made):
            ids[k] = found
        self.known.put_all(pieces, made)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.int32)
        first = np.cumsum(length) - length
        own = length[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(first[index] - ends[:-1], own)
        at += np.arange(ends[-1])
        return flat[at], ends[np.searchsorted(cuts, offsets)]
