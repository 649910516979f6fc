"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3 signs, a
word edge being a sign), ranked by their frequency in all its documents. A
document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of rank differences, where an n-gram that the
profile lacks counts the profile's length.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.text import chunks
from rowferry.session import settled as settle

#: N-grams of a profile, and of a document that are compared.
PROFILE = 400
UNKNOWN = "und"
#: Distinct n-grams that a task gathers before it adds them up.
GATHERED = 1 << 21

_U64 = np.uint64
#: Bits of one sign in an n-gram; there are fewer than 2**18 letters.
_BITS = 18


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point -> number of its lower-case letter from 1, or 0 for what is no letter."""
    lower = np.zeros(sys.maxunicode + 1, np.int64)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            lower[point] = ord(low) if len(low) == 1 and low.isalpha() else point
    kept = np.unique(lower[lower > 0])
    return np.where(lower > 0, np.searchsorted(kept, lower) + 1, 0).astype(_U64)


def signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all rows with an edge (0) before each word and after the last, and the row of each sign."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    codes = letter_codes()[points]
    at = np.flatnonzero(codes)
    codes, row = codes[at], row[at]
    # A word begins where the letter before is not next to this one or is in another row.
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(at) > 1) | (np.diff(row) > 0)
    last = np.ones(len(at), bool)
    last[:-1] = np.diff(row) > 0
    place = np.arange(len(at)) + np.cumsum(begins) + np.concatenate([[0], np.cumsum(last)[:-1]]) if len(at) else at
    total = len(at) + int(begins.sum() + last.sum())
    out, owner = np.zeros(total, _U64), np.zeros(total, np.int64)
    out[place] = codes
    owner[place] = row
    owner[place[begins] - 1] = row[begins]
    owner[place[last] + 1] = row[last]
    return out, owner


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a chunk as numbers, and their rows. Those of one or two letters have ones above them."""
    one, row = signs(data, offsets)
    letter = one > 0
    shift = _U64(_BITS)
    mark = _U64((1 << _BITS) - 1)
    found, owner = [one[letter] | mark << shift | mark << _U64(2 * _BITS)], [row[letter]]
    same = row[:-1] == row[1:]
    two = same & (letter[:-1] | letter[1:])
    found.append((one[:-1] << shift | one[1:] | mark << _U64(2 * _BITS))[two])
    owner.append(row[1:][two])
    if len(one) > 2:
        three = same[:-1] & same[1:] & letter[1:-1]
        found.append((one[:-2] << _U64(2 * _BITS) | one[1:-1] << shift | one[2:])[three])
        owner.append(row[2:][three])
    return np.concatenate(found), np.concatenate(owner)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def top_grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent n-grams of each row (at most 1024 rows): gram, row and rank from 0."""
    found, row = grams(data, offsets)
    keys, count = counted(row.astype(_U64) << _U64(54) | found)
    owner = (keys >> _U64(54)).astype(np.int64)
    if not len(keys):
        return keys, owner, owner
    # Row, then falling count, then the order of n-grams.
    index_bits, count_bits = len(keys).bit_length(), int(count.max()).bit_length()
    order = owner.astype(_U64) << _U64(index_bits + count_bits) | (count.max() - count).astype(_U64) << _U64(index_bits)
    order = np.sort(order | np.arange(len(keys), dtype=_U64))
    order = (order & _U64((1 << index_bits) - 1)).astype(np.int64)
    owner = owner[order]
    starts = np.searchsorted(owner, np.arange(len(offsets) - 1))
    rank = np.arange(len(order)) - starts[owner]
    take = rank < size
    return keys[order[take]] & _U64((1 << 54) - 1), owner[take], rank[take]


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the most frequent n-grams of each non-null lang, counted over all rows of (lang, text)."""
    docs = docs.where(F.col("lang").isNotNull()).select("lang", "text")

    def task(batches):
        names: list[str] = []
        keys, counts = [np.zeros(0, _U64)], [np.zeros(0, np.int64)]
        held = 0

        def added():
            joined, number = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(joined)
            joined, number = joined[order], number[order]
            first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, np.int64)
            return joined[first], np.add.reduceat(number, first) if len(first) else number

        def given():
            joined, number = added()
            lang = pa.array(names, pa.string()).take(pa.array((joined >> _U64(54)).astype(np.int64)))
            gram = (joined & _U64((1 << 54) - 1)).view(np.int64)
            return pa.RecordBatch.from_arrays([lang, pa.array(gram), pa.array(number)], ["lang", "gram", "n"])

        for batch in batches:
            for part, data, offsets in chunks(batch, rows=1000):
                langs = part.column("lang").dictionary_encode()
                own = langs.dictionary.to_pylist()
                # A number of a language has ten bits; a part has at most 1000 rows.
                if len(set(names).union(own)) > 1 << 10:
                    yield given()
                    names, keys, counts, held = [], [np.zeros(0, _U64)], [np.zeros(0, np.int64)], 0
                names += [name for name in own if name not in names]
                number = [names.index(name) for name in own]
                found, row = grams(data, offsets)
                lang = np.array(number, np.int64)[langs.indices.to_numpy()][row]
                key, count = counted(lang.astype(_U64) << _U64(54) | found)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held > GATHERED:
                    key, count = added()
                    keys, counts, held = [key], [count], len(key)
                    if held > GATHERED // 2:
                        yield given()
                        keys, counts, held = [np.zeros(0, _U64)], [np.zeros(0, np.int64)], 0
        if held:
            yield given()

    totals = docs.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def predict_languages(docs: DataFrame, profiles: DataFrame, columns: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """The given columns, lang_pred and score of each whole text.

    ``profiles`` has at most ``size`` rows a language and goes to every task.
    A null text, or one without letters, is `und` with score 0, as is every
    text when no language was learned; of equal distances the first language by
    name is taken. The score is 1 less the distance's share of the largest
    possible one. Rows are judged each for itself, with whole texts only.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for r in rows:
        ranks[np.searchsorted(known, r["gram"]), langs.index(r["lang"])] = r["rank"]
    shared = docs.sparkSession.sparkContext.broadcast((langs, known.view(_U64), ranks))

    def task(batches):
        langs, known, ranks = shared.value
        names = pa.array([*langs, UNKNOWN], pa.string())
        for batch in batches:
            for part, data, offsets in chunks(batch, rows=1000):
                n = part.num_rows
                gram, row, rank = top_grams(data, offsets, size)
                compared = np.bincount(row, minlength=n)
                best, least = np.full(n, len(langs)), compared * float(size)
                if len(langs):
                    spot = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    spot = np.where(known[spot] == gram, spot, len(known))
                    distance = np.empty((n, len(langs)))
                    for k in range(len(langs)):
                        theirs = ranks[spot, k]
                        distance[:, k] = np.bincount(row, weights=np.where(theirs < 0, size, np.abs(theirs - rank)), minlength=n)
                    best = np.where(compared > 0, distance.argmin(axis=1), len(langs))
                    least = distance.min(axis=1)
                score = np.where(compared > 0, 1 - least / np.maximum(compared * float(size), 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], [*columns, "lang_pred", "score"]
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, lang_pred string, score double")


def settled_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    return settle(learn_profiles(docs, size), "profiles")
