"""Byte-level BPE by the rank queue of a hierarchical bitmap.

The parts of a pre-token are a doubly linked list. A pair of neighbours waits
in the bucket of its merge rank; a two-level bitmap says which buckets hold
something, so the next rank is found by two find-first-set operations however
long the pre-token is. A waiting pair whose parts have changed since is stale
and skipped when it comes up. Merges cost the same anywhere in the list, so a
pre-token of a megabyte takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.text import chunks
from rowferry.llm.units import Remembered, UnitEncoder, kept_encoder

#: Ranks under one bit of the upper bitmap level: 2 ** SHIFT.
SHIFT = 8
MASK = (1 << SHIFT) - 1
#: Units that any pattern leaves whole that keeps one space in front of a word and splits by kinds of signs.
PLAIN_UNIT = re.compile(rb" ?[a-z]+").fullmatch
#: The white space of the pattern's engine; Python's also counts U+001C to U+001F.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def split_pattern(pattern: str) -> regex.Pattern:
    inside = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    return regex.compile(inside)


def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """Rank of each pair of single bytes, at first byte times 256 plus second; -1 for none."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge_ranks(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one pre-token: always the lowest rank next, the leftmost of equals."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    find = ranks.get
    # Rank of the pair that begins at each place; its bucket may hold places whose rank has changed.
    pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    blocks: dict[int, int] = {}
    upper = 0
    for k, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(k)
            else:
                buckets[rank] = [k]
                block = rank >> SHIFT
                blocks[block] = blocks.get(block, 0) | 1 << (rank & MASK)
                upper |= 1 << block
    while upper:
        block = (upper & -upper).bit_length() - 1
        bits = blocks[block]
        low = bits & -bits
        rank = (block << SHIFT) + low.bit_length() - 1
        bucket = buckets[rank]
        # Places of a bucket form a heap, so the leftmost comes first.
        if len(bucket) == 1:
            k = bucket[0]
            del buckets[rank]
            if bits == low:
                upper ^= 1 << block
            blocks[block] = bits ^ low
        else:
            k = heappop(bucket)
        if pair[k] != rank:
            continue
        gone = after[k]
        end = after[gone]
        after[k] = end
        pair[gone] = -1
        if end < n:
            before[end] = k
            new = find(piece[k : after[end]], -1)
        else:
            new = -1
        pair[k] = new
        left = before[k]
        while True:
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], k)
                else:
                    buckets[new] = [k]
                    block = new >> SHIFT
                    blocks[block] = blocks.get(block, 0) | 1 << (new & MASK)
                    upper |= 1 << block
            if left < 0:
                break
            # Then the pair to the left.
            pair[left] = new = find(piece[left:end], -1)
            k, left = left, -1
    out = []
    k = 0
    while k < n:
        end = after[k]
        out.append(ranks[piece[k:end]])
        k = end
    return out


@kept_encoder(2)
def _unit_encoder(path: str, pattern: str) -> UnitEncoder:
    """An encoder that keeps what it knows from task to task."""
    ranks = load_ranks(path)
    split = split_pattern(pattern).findall
    pairs = pair_ranks(ranks)
    known = Remembered()

    def one(piece: bytes) -> bytes:
        rank = ranks.get(piece)
        if rank is not None:
            return rank.to_bytes(4, sys.byteorder)
        found = known.get(piece)
        if found is None:
            found = np.array(merge_ranks(piece, ranks, pairs), np.int32).tobytes()
            known.put(piece, found)
        return found

    def unit(piece: bytes) -> bytes:
        if PLAIN_UNIT(piece):
            return one(piece)
        return b"".join([one(match.encode()) for match in split(piece.decode())])

    return UnitEncoder(lambda pieces: list(map(unit, pieces)))


def encode_texts(docs: DataFrame, ranks: str, pattern: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and ids (array<int>) of each whole text.

    A null or empty text has no ids; repeated rows are each given; a very long
    text is a chunk of its own; other columns are left out.
    """

    def task(batches):
        encode = _unit_encoder(ranks, pattern)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                ids, ends = encode(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                    [*columns, "ids"],
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, ids array<int>")


def spelled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, the start of each, and its length."""
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spelling of ids one after the other, and where each begins and the last ends."""
    flat, first, length = table
    own = length[ids]
    ends = np.concatenate([[0], np.cumsum(own)])
    return flat[np.arange(ends[-1]) + np.repeat(first[ids] - ends[:-1], own)], ends


def row_groups(cuts: np.ndarray, size: int = 1 << 18):
    """Ranges of rows with about ``size`` ids each; a longer row is a range of its own."""
    row, rows = 0, len(cuts) - 1
    while row < rows:
        stop = max(int(np.searchsorted(cuts, cuts[row] + size, "right")) - 1, row + 1)
        yield row, stop
        row = stop


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spelled([b"%d," % k for k in range(1 << 17)])


@lru_cache(maxsize=2)
def _token_table(ranks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = load_ranks(ranks)
    tokens = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        tokens[rank] = token
    return spelled(tokens)


def _spellings(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, cuts: np.ndarray):
    """For ranges of rows: first row, row after the last, their ids spelled in one array, and each row's ends in it."""
    for row, stop in row_groups(cuts):
        own = cuts[row : stop + 1]
        data, ends = joined(table, ids[own[0] : own[-1]])
        yield row, stop, data, ends[own - own[0]]


def _digests(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, cuts: np.ndarray, closing: int = 0) -> list[str]:
    """SHA-256 of each row's spelling without its last ``closing`` bytes."""
    found = []
    for _, _, data, ends in _spellings(table, ids, cuts):
        data = memoryview(np.ascontiguousarray(data))
        found += [hashlib.sha256(data[a : max(a, b - closing)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return found


def _list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list column in order, and where each row's begin and the last end."""
    cuts = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), cuts - cuts[0]


def id_digests(tokens: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns, n_tokens and ids_sha256, of the decimal ids joined by commas.

    A row without ids has the digest of nothing; repeated rows are each given;
    other columns are left out.
    """

    def task(batches):
        for batch in batches:
            ids, cuts = _list_parts(batch.column("ids"))
            digests = pa.array(_digests(_decimals(), ids, cuts, 1), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.diff(cuts)), digests], [*columns, "n_tokens", "ids_sha256"])

    tokens = tokens.select(*dict.fromkeys([*columns, "ids"]))
    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in columns)
    return tokens.mapInArrow(task, f"{kinds}, n_tokens long, ids_sha256 string")


def round_trips(docs: DataFrame, ranks: str, pattern: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns, n_tokens, ids_sha256 and decoded_sha256, in one pass over the texts.

    The same as `id_digests` and the digests of `decode_ids` over `encode_texts`,
    without sending ids and bytes through Spark. A null or empty text has no
    ids; repeated rows are each given; a very long text is a chunk of its own;
    other columns are left out.
    """

    def task(batches):
        encode, tokens = _unit_encoder(ranks, pattern), _token_table(ranks)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                ids, cuts = encode(data, offsets)
                digests = [pa.array(_digests(_decimals(), ids, cuts, 1), pa.string()), pa.array(_digests(tokens, ids, cuts), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.diff(cuts)), *digests], [*columns, "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(tokens: DataFrame, ranks: str, columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The given columns and decoded (binary): the bytes of each row's ids.

    A row without ids has no bytes; repeated rows are each given; other columns are left out.
    """

    def task(batches):
        for batch in batches:
            for row, stop, data, ends in _spellings(_token_table(ranks), *_list_parts(batch.column("ids"))):
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), decoded.cast(pa.binary())], [*columns, "decoded"])

    tokens = tokens.select(*columns)
    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in columns)
    return tokens.mapInArrow(task, f"{kinds}, decoded binary")
