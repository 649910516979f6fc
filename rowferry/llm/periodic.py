"""Periodic runs of words: maximal pairs of an LCP-interval tree.

The words of a chunk are suffix-sorted by prefix doubling, documents never
sharing a word. Each interval of equal prefixes, from the longest to the
shortest, keeps its positions in order, and by the word to their left. When
intervals join, two positions at distance q with a common prefix of l words and
different left words are a maximal pair: the words from the first position to
the second's prefix end are a stretch of period q that no neighbour extends. Only
pairs near enough for a stretch of the asked exponent are looked up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowferry.llm.text import NOT_SPACE, chunks, hash_spans, words

#: A run is at least this long, and this many times as long as its period.
LENGTH, TIMES = 6, 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def sorted_suffixes(code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and their ranks by the first 1, 2, 4, ... words.

    ``end`` is where a word's document ends; documents share no codes. Equal
    ranks of a level mean equal words of its whole length.
    """
    n = len(code)
    suffixes = np.argsort(code, kind="stable")
    slots, key, rank, levels = np.arange(n), code[suffixes], np.zeros(n + 1, np.int64), []
    while len(slots):
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        levels.append(rank[:n].astype(np.int32 if n < 1 << 31 else np.int64))
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        held, step = suffixes[slots], 1 << (len(levels) - 1)
        behind = np.minimum(held + step, n)
        key = rank[held] * (n + 1) + np.where(behind < end[held], rank[behind] + 1, 0)
        order = np.argsort(key, kind="stable")
        suffixes[slots], key = held[order], key[order]
    return suffixes, levels


def common_prefixes(suffixes: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """The common prefix of each suffix and the one before it; 0 where it is shorter than the power of two below ``least``."""
    n = len(suffixes)
    common, low = np.zeros(n, np.int64), max(least, 1).bit_length() - 1
    if len(levels) <= low or n < 2:
        return common
    a, b = suffixes[:-1], suffixes[1:]
    slots = np.flatnonzero(levels[low][a] == levels[low][b])
    a, b, found = a[slots], b[slots], np.zeros(len(slots), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + found, b + found
        inside = np.maximum(i, j) < n
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        found += same.astype(np.int64) << k
    common[slots + 1] = found
    return common


def maximal_pairs(suffixes: list[int], common: list[int], left: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """(first position, distance, common words) of maximal pairs whose distance is at most the common words by ``times - 1``.

    ``suffixes`` are those of one interval, in order; ``common[i]`` belongs to
    suffixes i - 1 and i, ``left`` are the words before them.
    """
    own = dict(zip(suffixes, left))

    def joined(one, other, depth):
        small, big = (one, other) if len(one[0]) <= len(other[0]) else (other, one)
        reach, (every, classes) = depth // (times - 1), big
        for p in small[0]:
            low, high = bisect_left(every, p - reach), bisect_right(every, p + reach)
            if low == high:
                continue
            word = own[p]
            if len(classes) <= high - low:
                near = (r for c, held in classes.items() if c != word for r in held[bisect_left(held, p - reach) : bisect_right(held, p + reach)])
            else:
                near = (r for r in every[low:high] if own[r] != word)
            for r in near:
                pairs.append((min(p, r), abs(p - r), depth))
        if len(small[0]) > 32:
            every.extend(small[0])
            every.sort()
        else:
            for p in small[0]:
                insort(every, p)
        for word, held in small[1].items():
            mine = classes.get(word)
            if mine is None:
                classes[word] = held
            elif len(held) > 32:
                mine.extend(held)
                mine.sort()
            else:
                for p in held:
                    insort(mine, p)
        return big

    stack = []
    for i, p in enumerate(suffixes):
        pairs: list[tuple[int, int, int]] = []
        depth = common[i + 1] if i + 1 < len(suffixes) else 0
        node = ([p], {own[p]: [p]})
        while stack and stack[-1][0] > depth:
            below, held = stack.pop()
            node = joined(held, node, below)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, joined(stack[-1][1], node, depth))
        else:
            stack.append((depth, node))
        yield from pairs


def word_runs(code: np.ndarray, row: np.ndarray, count: int, length: int = LENGTH, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """Row, start (word of the row), length and period of each run, by row, start and period.

    ``code`` numbers the words of ``count`` rows one after the other, equal words alike.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(code) < length:
        return none
    bounds = np.searchsorted(row, np.arange(count + 1))
    _, own = np.unique(row * (int(code.max()) + 1) + code, return_inverse=True)
    suffixes, levels = sorted_suffixes(own, bounds[row + 1])
    least = min(max((times - 1) * q, length - q) for q in range(1, length + 1))
    common = common_prefixes(suffixes, levels, least)
    # Intervals of enough common words; one without two positions near each other holds no pair.
    deep = common >= least
    member = np.flatnonzero(deep | np.append(deep[1:], False))
    if not len(member):
        return none
    begins = np.flatnonzero(~deep[member])
    sizes = np.diff(np.append(begins, len(member)))
    group = np.repeat(np.arange(len(begins)), sizes)
    at = suffixes[member]
    ordered = at[np.lexsort((at, group))]
    gap = np.append(np.diff(ordered), len(code))
    gap[begins + sizes - 1] = len(code)
    near = np.minimum.reduceat(gap, begins) * (times - 1) <= np.maximum.reduceat(common[member], begins)
    left = np.where(at > bounds[row[at]], own[np.maximum(at - 1, 0)], -1)
    shortest: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(near):
        part = slice(begins[k], begins[k] + sizes[k])
        for start, period, shared in maximal_pairs(at[part].tolist(), common[member[part]].tolist(), left[part].tolist(), times):
            if period + shared >= length:
                # A stretch of period q is met at its multiples too; the shortest counts.
                place = (start, period + shared)
                shortest[place] = min(shortest.get(place, period), period)
    if not shortest:
        return none
    start, size, period = np.array(sorted((s, n, q) for (s, n), q in shortest.items()), np.int64).T
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    return row[start], start - bounds[row[start]], size, period


def periodic_runs(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id",),
    length: int = LENGTH,
    times: int = TIMES,
    reorder: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """The given columns, n_words, runs (start, length, period by start, then period) and collapsed.

    A run is a stretch of consecutive words whose smallest period is q, of at
    least ``length`` words and ``times`` q, that no neighbouring word extends.
    ``collapsed`` are the words, joined by one space, without those that any
    run holds after its first q. ``reorder`` gives, from rows and their word
    counts, for every word the number of the one that stands in its place.

    Null and empty texts have no words, no runs and an empty ``collapsed``.
    Texts are taken whole, each in one task; time grows with their length times
    its logarithm. Rows are judged each for itself, repeated ones alike; extra
    columns are left out.
    """

    def task(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                starts, ends, row = words(data, offsets, NOT_SPACE)
                if reorder is not None:
                    placed = reorder(part, np.bincount(row, minlength=part.num_rows))
                    starts, ends = starts[placed], ends[placed]
                _, code = np.unique(hash_spans(data, starts, ends), return_inverse=True)
                own, first, size, period = word_runs(code, row, part.num_rows, length, times)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                repeats = np.zeros(len(starts) + 1, np.int64)
                np.add.at(repeats, bounds[own] + first + period, 1)
                np.add.at(repeats, bounds[own] + first + size, -1)
                kept = np.flatnonzero(np.cumsum(repeats[:-1]) == 0)
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(first), pa.array(size), pa.array(period)], fields=list(RUN)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.diff(bounds)), runs, _joined(data, starts[kept], ends[kept], row[kept], part.num_rows)],
                    [*columns, "n_words", "runs", "collapsed"],
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, count: int) -> pa.Array:
    """The words of each row joined by one space."""
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    size = ends - starts + ~last
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - stop + size, size)
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[stop[~last] - 1] = 0x20
    offsets = np.concatenate([[0], stop])[np.searchsorted(row, np.arange(count + 1))]
    return pa.StringArray.from_buffers(count, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))
