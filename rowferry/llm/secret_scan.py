"""Secret scans over a trigram inverted index.

From the syntax tree of each rule's pattern a Boolean query over trigrams is
derived that every match satisfies. The index is partitioned by documents:
each chunk of texts has posting lists from trigram to documents, built from
the case-folded bytes of whole texts. A rule's query intersects and unites
postings, and only the documents that remain are verified with the pattern.
A rule without a mandatory trigram scans all texts. ``write_index`` keeps the
posting lists of a corpus as a table, ``candidates`` answers queries from it;
``find_secrets`` builds, asks and verifies chunk by chunk without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as code
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.text import LOWER, chunks, words


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, and the group and length that a match must reach."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules in their order, then further kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that a set of exact alternatives may hold before it is given up.
MAX_EXACT = 64
Query = tuple  # ("all",) | ("tri", str) | ("and", *queries) | ("or", *queries)
ALL: Query = ("all",)


def _and(queries) -> Query:
    parts = sorted({q for q in queries if q != ALL}, key=repr)
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(queries) -> Query:
    parts = sorted(set(queries), key=repr)
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _trigrams(text: str) -> Query:
    data = text.encode().lower()
    return _and(("tri", data[k : k + 3]) for k in range(len(data) - 2))


def _concat(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_EXACT else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """All strings a part can match, or None, and a query that holds for its matches."""
    exact: set[str] = {""}
    queries: list[Query] = []
    whole = True
    for op, value in tree:
        if op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[0] >= 1 and (found := _walk(value[2])[0]) is not None:
            # What repeats stands behind what came before, and before what follows.
            whole = False
            queries.append(_or(map(_trigrams, _concat(exact, found) or exact)))
            exact = found
            continue
        found, query = _node(op, value)
        longer = _concat(exact, found) if found is not None else None
        if longer is not None:
            exact = longer
            continue
        # What was gathered ends here; trigrams across this place are given up.
        whole = False
        queries += [_or(map(_trigrams, exact)), query]
        exact = {""} if found is None else found
    return (exact, ALL) if whole else (None, _and([*queries, _or(map(_trigrams, exact))]))


def _node(op, value) -> tuple[set[str] | None, Query]:
    if op is code.LITERAL:
        return {chr(value)}, ALL
    if op is code.AT:
        return {""}, ALL
    if op is code.SUBPATTERN:
        return _walk(value[3])
    if op is code.IN:
        chars = [v for o, v in value if o is code.LITERAL]
        return ({chr(c) for c in chars} if len(chars) == len(value) <= 8 else None), ALL
    if op is code.BRANCH:
        parts = [_walk(branch) for branch in value[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MAX_EXACT:
            return set().union(*(e for e, _ in parts)), ALL
        return None, _or(_and([q, _or(_trigrams(x) for x in e)]) if e is not None else q for e, q in parts)
    if op in (code.MAX_REPEAT, code.MIN_REPEAT):
        low, high, part = value
        exact, query = _walk(part)
        if low == 0 and high == 1 and exact is not None:
            return exact | {""}, ALL
        if low == 0:
            return None, ALL
        return None, _and([query, _or(_trigrams(x) for x in exact)]) if exact is not None else query
    return None, ALL


def trigram_query(pattern: str) -> Query:
    """A query that the folded trigrams of every text with a match satisfy; ALL if none is mandatory."""
    exact, query = _walk(parser.parse(pattern))
    return _and([query, _or(_trigrams(x) for x in exact)]) if exact is not None else query


def trigrams_of(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:])) if query[0] != "all" else set()


def number(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (trigram, row) pairs of a chunk, sorted: the posting lists one after the other."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = LOWER[data].astype(np.uint64)
    grams = folded[:-2] << np.uint64(16) | folded[1:-1] << np.uint64(8) | folded[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    keys = grams[inside] << np.uint64(32) | row[:-2][inside].astype(np.uint64)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def answer(query: Query, lookup: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
    """Rows that satisfy the query."""
    if query[0] == "all":
        return np.arange(rows)
    if query[0] == "tri":
        return lookup(number(query[1]))
    parts = [answer(q, lookup, rows) for q in query[1:]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    found = parts[0]
    for part in parts[1:]:
        found = np.intersect1d(found, part, assume_unique=True)
    return found


def _hex_runs(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> dict[int, list[tuple[int, int]]] | None:
    """Matches of a rule that is a run of one class of ASCII characters, over all texts at once; byte places."""
    tree = list(parser.parse(rule.pattern))
    if len(tree) != 1 or tree[0][0] is not code.MAX_REPEAT or rule.group:
        return None
    low, high, part = tree[0][1]
    if low != 1 or high != code.MAXREPEAT or len(part) != 1 or part[0][0] is not code.IN:
        return None
    allowed = np.zeros(256, bool)
    for op, value in part[0][1]:
        if op is code.RANGE and value[1] < 128:
            allowed[value[0] : value[1] + 1] = True
        elif op is code.LITERAL and value < 128:
            allowed[value] = True
        else:
            return None
    starts, ends, row = words(data, offsets, allowed)
    long = ends - starts >= rule.least
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in zip(starts[long].tolist(), ends[long].tolist(), row[long].tolist()):
        found.setdefault(r, []).append((a, b))
    return found


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the pattern, those whose group is too short left out."""
    compiled = re.compile(rule.pattern, re.ASCII)
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def scan_chunk(rules: tuple[Rule, ...], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) in code points of each row, sorted."""
    rows = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    grams, owner = postings(data, offsets)

    def lookup(gram):
        return owner[np.searchsorted(grams, gram, "left") : np.searchsorted(grams, gram, "right")]

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    whole = data.tobytes()
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        runs = _hex_runs(data, offsets, rule) if query == ALL else None
        if runs is not None:
            for r, spans in runs.items():
                base = points[offsets[r]]
                found[r] += [(int(points[a] - base), k, int(points[b] - base)) for a, b in spans]
            continue
        for r in answer(query, lookup, rows).tolist():
            text = whole[offsets[r] : offsets[r + 1]].decode()
            found[r] += [(a, k, b) for a, b in matches(rule, text)]
    return [sorted(spans) for spans in found]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and spans (kind, start, end in code points, end exclusive).

    Spans stand by start, then by the order of rules; matches of one rule do
    not overlap. A null text is empty and has none. Every row is scanned for
    itself; repeated ids do not matter.
    """

    def task(batches):
        names = pa.array([r.kind for r in rules], pa.string())
        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = scan_chunk(rules, data, offsets)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.array([s for spans in found for s in spans], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.ListArray.from_arrays(pa.array(cuts), spans)], [*columns, "spans"])

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, spans {SPANS}")


def write_index(docs: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Posting lists of all texts: rows (block, trigram, doc_ids), sorted by trigram in each file."""
    docs = docs.select(F.col(id_column).alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, data, offsets in chunks(batch):
                grams, row = postings(data, offsets)
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
                cuts = np.append(first, len(grams)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), part.column("doc_id").take(pa.array(row)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), block)), pa.array(grams[first].astype(np.int32)), lists], ["block", "trigram", "doc_ids"]
                )
                block += 1

    rows = docs.mapInArrow(task, f"block long, trigram int, doc_ids array<{kind}>")
    rows.sortWithinPartitions("trigram").write.parquet(path)


def candidates(index: DataFrame, query: Query) -> DataFrame:
    """Distinct doc_ids of an index that satisfy a query with mandatory trigrams."""
    if query == ALL:
        raise ValueError("a query without mandatory trigrams has all documents as candidates")
    wanted = {number(t) for t in trigrams_of(query)}
    lists = index.where(F.col("trigram").isin(sorted(wanted))).select("trigram", F.explode("doc_ids").alias("doc_id"))
    held = lists.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def holds(q):
        if q[0] == "tri":
            return F.array_contains("held", number(q[1]))
        parts = [holds(x) for x in q[1:]]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if q[0] == "and" else out | part
        return out

    return held.where(holds(query)).select("doc_id")


def mask(spans: str = "spans", text: str = "text", marker: str = "[SECRET]"):
    """The text with its spans, overlapping ones joined, replaced by the marker."""
    text = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(state, span):
        fresh = span["start"] >= state["done"]
        until = F.greatest(state["done"], span["end"])
        kept = F.substring(text, (state["done"] + 1).cast("int"), F.greatest(span["start"] - state["done"], F.lit(0)).cast("int"))
        return F.struct(F.when(fresh, F.concat(state["out"], kept, F.lit(marker))).otherwise(state["out"]).alias("out"), until.alias("done"))

    rest = F.aggregate(F.col(spans), start, step, lambda s: F.concat(s["out"], F.substring(text, (s["done"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, rest)
