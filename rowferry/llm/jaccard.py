"""Near-duplicate join on word shingles by the size-aware heavy-light method.

Texts with the same shingle set form a class; only classes are compared.

*Small* sets (size up to a boundary) enumerate subsets of a fixed size: two
sets of sizes s and t are alike exactly if they share ``needed(s, t)``
shingles, so each enumerates its subsets of that size for every partner size,
and equal subsets are links without a further check. Members of one subset are
linked to its least member of the smaller size, not pair by pair.

*Large* sets scan inverted lists. Lists hold the first shingles of each set in
one order for all: rare shingles by hash, then shingles counted as frequent by
rising count. Alike sets share a shingle among these, at positions that still
allow the needed overlap. The boundary takes the least of the estimated costs
of enumerating and of scanning.

A list that one group of near copies fills would give all pairs. So each list
compares each member with a few others first; what they link is one component
from then on, and only pairs across components remain to be compared. After
each round links are contracted: components are the nodes of the next round.
Bit maps of the sets bound what a pair can share, so that whole sets travel
only for pairs that may be alike.

Shingles are 54 bits of a 64-bit hash; candidate pairs are checked on whole sets.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.components import Scratch, components, merged, small_batches
from rowferry.llm.text import LOWER, NOT_SPACE, chunks, gram_hashes, hash_spans, mix, words
from rowferry.llm.units import release_encoders
from rowferry.session import settled as settle

WORDS = 5
#: Similarity in percent from which sets are alike.
PERCENT = 75
#: Frequent shingles that every task knows; the most frequent ones of the corpus. Only the order of lists depends on it.
FREQUENT = 1 << 19
#: Shingles that a task counts at once.
GATHERED = 1 << 21
#: Members up to which every pair of a list is looked at when entries are thinned out; longer lists go by their extremes.
SHORT = 64
#: Earlier lists that an entry remembers, to see whether a pair has met before.
REMEMBERED = 64
#: Bits of the map that lets a task pass over texts that are not asked for.
MAP_BITS = 1 << 26
#: Largest boundary that is considered, and the cost of a list entry in subsets.
MAX_SMALL = 24
LIST_COST = 4
#: Comparisons of a list member in a round before the exhaustive one, and members of a part of a list then.
NEXT, PART = 3, 512
#: The exhaustive round follows when it looks at no more pairs than a round, when fewer than this share of a round's pairs
#: are alike, or after so many rounds.
FRUITFUL, TURNS = 0.05, 6

#: Bits of a set's map for each shingle, at least, and the least length of a map.
SKETCH_BITS, LEAST_BITS = 4, 512

_ROWS = 1000
#: Parts of the entries.
SUBSET, RARE, OFTEN = 0, 1, 2
_ELEMENT_BITS = 54
_U64 = np.uint64


def needed(a, b, percent: int = PERCENT):
    """Common shingles that two sets of sizes a and b need; takes integers or columns."""
    if isinstance(a, Column):
        return F.ceil((a + b) * percent / F.lit(100.0 + percent))
    return -(-percent * (a + b) // (100 + percent))


def most_partner(n, percent: int = PERCENT):
    """The largest size that a set alike to one of size n can have."""
    return n * 100 // percent


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted by row and value, and the row of each."""
    starts, ends, row = words(data, offsets, NOT_SPACE)
    hashes = hash_spans(data, starts, ends, LOWER)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    grams = gram_hashes(hashes, WORDS)
    at = np.flatnonzero(row[: len(grams)] == row[WORDS - 1 :]) if len(grams) else np.zeros(0, np.int64)
    found, owner = [grams[at]], [row[at]]
    first = np.cumsum(count) - count
    for size in range(1, WORDS):
        own = np.flatnonzero(count == size)
        if len(own):
            found.append(gram_hashes(hashes, size)[first[own]])
            owner.append(own)
    keys = np.concatenate(owner).astype(_U64) << _U64(_ELEMENT_BITS) | np.concatenate(found) >> _U64(64 - _ELEMENT_BITS)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys & _U64((1 << _ELEMENT_BITS) - 1), (keys >> _U64(_ELEMENT_BITS)).astype(np.int64)


def class_ids(shingles: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each row's set, and the set's size."""
    size = np.bincount(row, minlength=rows)
    sums = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(shingles + _U64(1)))])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mix((sums[edge[1:]] - sums[edge[:-1]]) + size.astype(_U64)).view(np.int64), size


def _first_of_class(ids: np.ndarray, size: np.ndarray, seen: set) -> np.ndarray:
    """Rows with a set whose class this task has not met before."""
    keep = np.zeros(len(ids), bool)
    _, first = np.unique(ids, return_index=True)
    for k in first[size[first] > 0].tolist():
        if (value := int(ids[k])) not in seen:
            seen.add(value)
            keep[k] = True
    return keep


def _census(docs: DataFrame) -> DataFrame:
    """(doc_id, class, size) of each row, and (shingle, count) of shingles that classes of one task share.

    A task counts in windows of GATHERED shingles and reports what occurs more
    than once in a window, so the counts of frequent shingles are close and
    rare ones cost nothing.
    """

    def task(batches):
        release_encoders()
        kind, gathered, held, seen = None, [], 0, set()

        def counts():
            values, count = np.unique(np.concatenate(gathered) if gathered else np.zeros(0, _U64), return_counts=True)
            values, count = values[count > 1], count[count > 1]
            m = len(values)
            empty = [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())]
            return pa.RecordBatch.from_arrays(empty + [pa.array(values.view(np.int64)), pa.array(count.astype(np.int64))], columns)

        columns = ["doc_id", "class", "size", "shingle", "count"]
        for batch in batches:
            kind = batch.column("doc_id").type
            for part, data, offsets in chunks(batch, rows=_ROWS):
                shingles, row = shingle_sets(data, offsets)
                ids, size = class_ids(shingles, row, part.num_rows)
                gathered.append(shingles[_first_of_class(ids, size, seen)[row]])
                held += len(gathered[-1])
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids), pa.array(size.astype(np.int32)), none, none], columns)
                if held > GATHERED:
                    yield counts()
                    gathered, held = [], 0
        if held:
            yield counts()

    kind = docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        return settle(docs.mapInArrow(task, f"doc_id {kind}, class long, size int, shingle long, count long"), "census")


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles in order and their counts: all above the count that leaves so many."""
    tail = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("c")).collect()
    total, least = 0, 1 << 62
    for r in sorted(tail, key=lambda r: -r["n"]):
        total += r["c"]
        if total > FREQUENT:
            break
        least = r["n"]
    held = counts.where(F.col("n") >= least).toArrow()
    shingles, n = held["shingle"].to_numpy().view(_U64), held["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


@lru_cache(maxsize=None)
def _partner_sizes(size: int) -> tuple[tuple[int, int], ...]:
    """(smaller, larger) sizes of all alike pairs that a set of this size can be in."""
    out = [(size, t) for t in range(size, most_partner(size) + 1) if needed(size, t) <= size]
    return tuple(out + [(s, size) for s in range(1, size) if most_partner(s) >= size and needed(s, size) <= s])


def subset_count(size: int) -> int:
    return sum(comb(size, needed(s, t)) for s, t in _partner_sizes(size))


def prefix_length(size: int) -> int:
    """First shingles of a set of which a set alike must hold one, for the smallest partner."""
    return size + (PERCENT * size // -100) + 1


def boundary(histogram: dict[int, int]) -> int:
    """The size up to which enumerating subsets is estimated to cost least."""

    def cost(x):
        light = sum(c * subset_count(n) for n, c in histogram.items() if 0 < n <= x)
        return light + sum(c * LIST_COST * prefix_length(n) for n, c in histogram.items() if 100 * n >= PERCENT * (x + 1))

    return min(range(MAX_SMALL + 1), key=lambda x: (cost(x), x))


def subsets(shingles: np.ndarray) -> tuple[list[int], list[bool]]:
    """Hashes of a small set's subsets for each partner size, and whether the set is the smaller of the pair."""
    size, keys, smaller = len(shingles), [], []
    for s, t in _partner_sizes(size):
        choose = np.array(list(combinations(range(size), needed(s, t))))
        mixed = mix(shingles + _U64(1000 * s + t))
        keys.append(mix(mixed[choose].sum(axis=1, dtype=_U64)).view(np.int64))
        smaller.append(np.full(len(choose), s == size))
    return np.concatenate(keys), np.concatenate(smaller)


def _entries(docs: DataFrame, frequent, small: int, scratch: Scratch) -> DataFrame:
    """Rows (part, key, class, size, place): subsets (place 1 for the smaller size), rare and frequent list entries."""
    shared = scratch.share(frequent)

    def task(batches):
        release_encoders()
        values, rank = shared.value
        known = np.zeros(1 << 20, bool)
        known[values & _U64((1 << 20) - 1)] = True
        seen: set[int] = set()
        for batch in batches:
            for part, data, offsets in chunks(batch, rows=_ROWS):
                shingles, row = shingle_sets(data, offsets)
                ids, size = class_ids(shingles, row, part.num_rows)
                fresh = _first_of_class(ids, size, seen)
                edge = np.cumsum(size) - size
                for k in np.flatnonzero(fresh & (size <= small)).tolist():
                    keys, smaller = subsets(shingles[edge[k] : edge[k] + size[k]])
                    yield _batch(SUBSET, keys, np.full(len(keys), ids[k]), np.full(len(keys), size[k]), smaller)
                listed = fresh & (100 * size >= PERCENT * (small + 1))
                own = listed[row]
                shingles, row = shingles[own], row[own]
                prefix = size + (PERCENT * size // -100) + 1
                order = np.zeros(len(shingles), np.int64)
                maybe = np.flatnonzero(known[shingles & _U64((1 << 20) - 1)])
                if len(maybe) and len(values):
                    spot = np.minimum(np.searchsorted(values, shingles[maybe]), len(values) - 1)
                    hit = values[spot] == shingles[maybe]
                    order[maybe[hit]] = rank[spot[hit]]
                rare = order == 0
                rares = np.bincount(row[rare], minlength=part.num_rows)
                place = np.arange(rare.sum()) - (np.cumsum(rares) - rares)[row[rare]]
                take = place < prefix[row[rare]]
                owner = row[rare][take]
                yield _batch(RARE, shingles[rare][take].view(np.int64), ids[owner], size[owner], place[take])
                late = np.flatnonzero(~rare & (rares < prefix)[row])
                late = late[np.lexsort((shingles[late], order[late], row[late]))]
                lates = np.bincount(row[late], minlength=part.num_rows)
                place = np.arange(len(late)) - (np.cumsum(lates) - lates)[row[late]] + rares[row[late]]
                take = place < prefix[row[late]]
                owner = row[late][take]
                yield _batch(OFTEN, shingles[late][take].view(np.int64), ids[owner], size[owner], place[take])

    return docs.mapInArrow(task, "part int, key long, class long, size int, place int")


def _batch(kind, keys, ids, size, place):
    arrays = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(ids)]
    return pa.RecordBatch.from_arrays(
        arrays + [pa.array(np.asarray(size).astype(np.int32)), pa.array(np.asarray(place).astype(np.int32))],
        ["part", "key", "class", "size", "place"],
    )


def _light_links(entries: DataFrame) -> DataFrame:
    """Members of a subset with its least member of the smaller size."""
    pivots = entries.groupBy("key").agg(F.min(F.when(F.col("place") == 1, F.col("class"))).alias("b"), F.count("*").alias("n")).where("n > 1 AND b IS NOT NULL")
    return entries.join(pivots, "key").select(F.col("class").alias("a"), "b").where("a <> b").distinct()


def _reach() -> Column:
    """The largest partner size for which a first common shingle at this place leaves enough to share."""
    return F.floor((F.col("size") - F.col("place")) * (100 + PERCENT) / F.lit(PERCENT)) - F.col("size")


def _lists(entries: DataFrame) -> DataFrame:
    """Subsets, and list entries that some other member of their list may be alike to, in one pass over the entries.

    Only rare shingles are looked at by list. The other entries, whose lists may be long, are dealt one by one.
    """
    rare = F.col("part") == RARE
    dealt = F.when(rare, F.col("key")).otherwise(F.xxhash64("key", "class"))
    over = Window.partitionBy("part", dealt)
    # What follows from an entry is told after the entries have travelled.
    told = (
        entries.repartition(dealt)
        .withColumn("reach", F.when(F.col("part") != SUBSET, _reach()))
        .withColumns(
            {
                "one": F.min("class").over(over),
                "other": F.max("class").over(over),
                "n": F.count("*").over(over),
                "sizes": F.sum("size").over(over),
                "reaches": F.sum("reach").over(over),
                "least": F.min("size").over(over),
                "furthest": F.max("reach").over(over),
            }
        )
        .where(~rare | (F.col("one") != F.col("other")))
        .where(~rare | F.expr("CASE WHEN n = 2 THEN sizes - size <= reach AND reaches - reach >= size ELSE least <= reach AND furthest >= size END"))
    )
    # A shingle is rare or frequent, so that a list has entries of one part.
    kept = told.select("key", "class", "size", "place", "reach", "part").dropDuplicates(["part", "key", "class"])
    return kept.withColumn("part", F.when(F.col("part") == SUBSET, SUBSET).otherwise(RARE))


def _thinned(lists: DataFrame) -> DataFrame:
    """The entries that fit another member of their list."""
    facts = lists.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("reach").alias("furthest"))
    sized = lists.join(facts.where("n > 1"), "key")
    own = ["class", "size", "place", "reach"]
    short = sized.where(F.col("n") <= SHORT).groupBy("key").agg(F.collect_list(F.struct(*own)).alias("all"))
    fits = F.filter(
        "all",
        lambda x: F.exists("all", lambda y: (x["class"] != y["class"]) & (x["size"] <= y["reach"]) & (y["size"] <= x["reach"])),
    )
    long = sized.where(F.col("n") > SHORT).where("least <= reach AND furthest >= size")
    return short.select("key", F.explode(fits).alias("x")).select("key", "x.*").unionByName(long.select("key", *own))


def _spots(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))


def _bitmaps(of: DataFrame, *chosen: str) -> list[np.ndarray]:
    """For each of the columns a bit map of the document ids in it."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), _spots(ids).alias("spot")) for k, ids in enumerate(chosen))))
    bits = of.select(sides.alias("x")).select("x.*").groupBy("side", F.expr("spot div 32768").alias("page"))
    maps = np.zeros((len(chosen), MAP_BITS // 32768, 4096), np.uint8)
    for r in bits.agg(F.bitmap_construct_agg(F.pmod("spot", F.lit(32768))).alias("bits")).collect():
        maps[r["side"], r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return [m.ravel() for m in maps]


def _members(docs: DataFrame, bitmap: np.ndarray, scratch: Scratch, sketched: bool = False) -> DataFrame:
    """(doc_id, class, shingles) of the chosen documents, and of some others; ``sketched`` gives (doc_id, class, size, sketch).

    A bit map of fixed size over document ids spares the texts of others; what
    it lets through by chance falls out of the join with the pairs.
    """
    shared = scratch.share(bitmap)

    def task(batches):
        release_encoders()
        bitmap = shared.value
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            held = bitmap[spot >> 3] >> (spot & 7) & 1
            batch = batch.filter(pa.array(held.astype(bool)))
            for part, data, offsets in chunks(batch, rows=_ROWS):
                shingles, row = shingle_sets(data, offsets)
                ids, size = class_ids(shingles, row, part.num_rows)
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                if sketched:
                    maps = [sketch(shingles[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    told = {"size": pa.array(size.astype(np.int64)), "sketch": pa.array(maps, pa.binary())}
                else:
                    told = {"shingles": pa.ListArray.from_arrays(pa.array(cuts), pa.array(shingles.view(np.int64)))}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids), *told.values()], ["doc_id", "class", *told])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = "size long, sketch binary" if sketched else "shingles array<long>"
    return docs.withColumn("spot", _spots("doc_id")).mapInArrow(task, f"doc_id {kind}, class long, {told}")


def sketch(shingles: np.ndarray) -> bytes:
    """A set's bit map; its length is a power of two and follows from the set's size."""
    bits = max(LEAST_BITS, 1 << int(SKETCH_BITS * len(shingles) - 1).bit_length()) if len(shingles) else LEAST_BITS
    found = np.zeros(bits, bool)
    found[shingles & _U64(bits - 1)] = True
    return np.packbits(found).tobytes()


def may_be_alike(x: bytes, n: int, y: bytes, m: int) -> bool:
    """Whether sets of sizes n and m with these bit maps can be alike; never false for sets that are.

    A bit that only one map has stands for a shingle, at least, that the other set lacks. The longer map
    is folded to the shorter one's length.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    length = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, length), axis=0) for v in (a, b))
    shared = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return shared >= needed(n, m)


def _one_document(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each of the classes, with the other columns of ``classes``."""
    return documents.select("class", "doc_id").join(classes, "class").groupBy(*classes.columns).agg(F.min("doc_id").alias("doc_id"))


def _other(x: str, y: str) -> Column:
    """Whether two ids differ. They are no key of a join that asks this, so that its rows lie by class for the next step."""
    return F.coalesce(F.col(x) != F.col(y), F.col(x).isNull() != F.col(y).isNull())


def _sketches(docs: DataFrame, documents: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, size, sketch, doc_id) of the classes; all that is read of a class is read from this document."""
    chosen = scratch.settle(_one_document(documents, classes), "chosen")
    own = chosen.select(F.col("class").alias("c"), F.col("doc_id").alias("d"))
    found = _members(docs, *_bitmaps(chosen, "doc_id"), scratch, sketched=True).join(own, (F.col("class") == F.col("c")) & ~_other("doc_id", "d"), "left_semi")
    # A repeated id may stand for a class twice, with the same set.
    sketches = scratch.settle(found.select("class", "size", "sketch", "doc_id").dropDuplicates(["class"]), "sketches")
    scratch.forget()
    return sketches


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose bit maps let them be alike, with their other columns and the documents doc_a and doc_b."""
    kinds = {c: "long" for c in pairs.columns}
    for side in ("a", "b"):
        known = {"class": side, "size": f"n_{side}", "sketch": f"map_{side}", "doc_id": f"doc_{side}"}
        pairs = pairs.join(sketches.select(*(F.col(c).alias(name) for c, name in known.items())), side)
        kinds[f"doc_{side}"] = sketches.schema["doc_id"].dataType.simpleString()
    columns = list(kinds)

    def task(batches):
        for batch in batches:
            x, n, y, m = (batch.column(c).to_pylist() for c in ("map_a", "n_a", "map_b", "n_b"))
            yield batch.select(columns).filter(pa.array([may_be_alike(*p) for p in zip(x, n, y, m)], pa.bool_()))

    return pairs.select(*columns, "map_a", "n_a", "map_b", "n_b").mapInArrow(task, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def _alike(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; a class is read from one document, doc_a or doc_b.

    A pair carries the set of its ``a``, so ``b`` is best the one that many pairs have.
    """
    bitmaps = _bitmaps(pairs, "doc_a", "doc_b")
    for side, bitmap, shingles in (("a", bitmaps[0], "x"), ("b", bitmaps[1], "y")):
        sets = _members(docs, bitmap, scratch).select(F.col("class").alias("c"), F.col("doc_id").alias("d"), F.col("shingles").alias(shingles)).hint("merge")
        found = pairs.join(sets, (F.col(side) == F.col("c")) & ~_other(f"doc_{side}", "d"))
        pairs = found.drop("c", "d", f"doc_{side}")
    common = F.size(F.array_intersect("x", "y"))
    checked = pairs.select("a", "b", common.alias("c"), (F.size("x") + F.size("y") - common).alias("u"))
    links = scratch.settle(checked.where(f"100 * c >= {PERCENT} * u").select("a", "b").distinct(), "alike")
    scratch.forget()
    return links


def _possible(joined: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of list entries that met."""
    a, b = F.col("l.class"), F.col("p.class")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


_FITS = "l.component <> p.component AND l.size <= p.reach AND p.size <= l.reach"


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists with their members' components and number ``n``, without those in one component.

    ``left`` is the number of partners that a member may have in an exhaustive
    round: all of its list, or none for those of the list's least component.
    """
    own = lists.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "x", "n")
    return own.join(mixed, "key").withColumn("left", F.when(F.col("component") != F.col("x"), F.col("n")).otherwise(0)).drop("x")


def _few_left(lists: DataFrame) -> bool:
    """Whether an exhaustive round looks at no more pairs than any other round."""
    return lists.agg(F.coalesce(F.sum("left") <= NEXT * F.count("*"), F.lit(True)).alias("few")).first()["few"]


def _told_lists(lists: DataFrame) -> DataFrame:
    """Entries with the marks of earlier lists that their class is in, if those are at most REMEMBERED.

    A pair need not be looked at again after its first list. Only lists of the
    class that are still open are told, and no more than are asked for.
    """
    first = F.row_number().over(Window.partitionBy("class").orderBy("place", "key"))
    counted = lists.withColumn("turn", first)
    places = counted.where(F.col("turn") <= REMEMBERED + 1).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("turn", "key"))).alias("all"))
    told = counted.join(places.where(F.size("all") <= REMEMBERED), "class", "left")
    before = F.filter("all", lambda x: x["turn"] < F.col("turn"))["key"]
    return told.withColumn("earlier", F.coalesce(before, F.array().cast("array<long>"))).drop("all", "turn")


def _few_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """For each list member a few pairs with members of other components of its lists.

    Members stand in an order of classes that is the same for all lists, so
    that lists of one group of near copies agree on who comes next, and another
    one in every turn. A member meets the next ones of its lists; of all these
    it takes the NEXT first, with their order. Long lists are cut into parts by class.
    """
    order = F.xxhash64("class", F.lit(turn))
    part = F.pmod(F.xxhash64("class", F.lit(-1 - turn)), F.ceil(F.col("n") / PART))
    dealt = lists.withColumns({"order": order, "part": part})
    over = Window.partitionBy("key", "part").orderBy("order", "class")
    own = F.struct("class", "component", "size", "reach", "order")
    dealt = dealt.withColumn("next", F.array(*(F.lead(own, k).over(over) for k in range(1, NEXT + 1))))
    near = F.filter(
        "next",
        lambda x: (x["component"] != F.col("component")) & (x["size"] <= F.col("reach")) & (F.col("size") <= x["reach"]),
    )
    met = dealt.select(F.col("class").alias("a"), F.explode(near).alias("x"))
    # Tasks leave out repeated pairs before these travel.
    all_met = F.array_sort(F.collect_set(F.struct(F.col("x.order").alias("order"), F.col("x.class").alias("b"))))
    return met.groupBy("a").agg(F.slice(all_met, 1, NEXT).alias("x")).select("a", F.explode("x").alias("x")).select("a", "x.b", "x.order")


def _first_pairs(pairs: DataFrame) -> DataFrame:
    """Of each ``a`` the pair that comes first: one link joins it to its group."""
    return pairs.groupBy("a").agg(F.min_by(F.struct("b", "doc_a", "doc_b"), F.struct("order", "b")).alias("x")).select("a", "x.*")


def _all_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of list members across components: those outside the list's largest component with all others."""
    groups = lists.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = groups.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = lists.join(main, "key").where("component <> main")
    once = " AND NOT arrays_overlap(l.earlier, p.earlier) AND (p.component = l.main OR l.class < p.class)"
    return _possible(lists.alias("p").join(rest.alias("l"), F.expr("l.key = p.key AND " + _FITS + once)))


def similar_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: the id, n_shingles and component_id, the smallest id reachable by links.

    A text without words, or null, has no shingles and is its own component;
    rows of equal texts are linked. Ids are smallest in their own order; a null
    id is taken only where a component has no other. Repeated ids keep a row
    each. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), "text")
    census = _census(docs)
    documents = census.where("class IS NOT NULL").select("doc_id", "class", "size")
    counts = census.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n"))
    frequent = _most_frequent(settle(counts, "counts"))
    sizes = documents.where(F.col("size").between(1, 2 * MAX_SMALL)).groupBy("class", "size").count().groupBy("size").count().collect()
    scratch = Scratch(docs.sparkSession)
    entries = _entries(docs, frequent, boundary({r["size"]: r["count"] for r in sizes}), scratch)
    entries = scratch.settle(_lists(entries), "lists")
    scratch.forget()
    lists = scratch.settle(_thinned(entries.where(F.col("part") == RARE).drop("part")), "thinned")
    links = scratch.settle(_light_links(entries.where(F.col("part") == SUBSET)), "light")
    labels = scratch.settle(components(links, scratch), "labels")
    scratch.drop(entries, links)
    sketches = _sketches(docs, documents, lists.select("class").distinct(), scratch)
    turn, exhaustive = 0, False
    while True:
        rest = scratch.settle(_open_lists(lists.select("key", "class", "size", "place", "reach"), labels), "open")
        exhaustive = exhaustive or (turn > 0 and _few_left(rest))
        met = _promising(_all_pairs(_told_lists(rest)) if exhaustive else _few_pairs(rest, turn), sketches)
        pairs = scratch.settle(met if exhaustive else _first_pairs(met), "pairs")
        links = _alike(pairs, docs, scratch)
        compared, found = pairs.count(), links.count()
        before, labels = labels, merged(labels, links, scratch)
        # What is in one component is not looked at again.
        scratch.drop(lists, pairs, links, before)
        lists, turn = rest, turn + 1
        if exhaustive:
            break
        exhaustive = found < FRUITFUL * compared or turn == TURNS
    scratch.drop(lists, sketches)
    grouped = documents.where("size > 0").join(labels.withColumnRenamed("node", "class"), "class", "left")
    grouped = settle(grouped.withColumn("component", F.coalesce("component", "class")), "grouped")
    scratch.drop(labels)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (
        grouped.join(least, "component")
        .select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
        .unionByName(documents.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
        .withColumnRenamed("doc_id", id_column)
    )
