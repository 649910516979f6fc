import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowferry.llm import bpe, units
from rowferry.llm import components as C
from rowferry.llm import jaccard as J
from rowferry.llm.components import BATCH_CONF, Scratch, components
from rowferry.llm.queries import BYTE_RANKS
from rowferry.llm.tokens import pattern, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Per row: id, set size, smallest id reachable by links."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            group[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar_documents(frame).collect()), key=repr)


def corpus(seed):
    """Copies at every distance, a passage that many share, tiny sets, one group of near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=40)
    base = rng.choices(vocabulary, k=80)
    out = []
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.randint(1, 30))
        out.append(words)
        copy = list(words)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(copy)
    for _ in range(25):
        out.append(rng.choices(vocabulary, k=rng.randint(5, 60)) + passage)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(copy[: rng.randint(70, 80)])
    out += [out[0], out[3], ["x"], ["X"], []]
    return [(k + 1, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame) == brute(rows)


@pytest.mark.parametrize("small", [0, 6, 12])
def test_any_boundary_gives_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(J, "boundary", lambda histogram: small)
    monkeypatch.setattr(J, "FREQUENT", 8)
    monkeypatch.setattr(J, "SHORT", 3)
    rows = corpus(4)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_edge_cases(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert found(no_docs) == []


def test_needed_and_partner_sizes():
    for a in range(1, 40):
        for b in range(a, 60):
            least = next((c for c in range(1, a + 1) if 100 * c >= 75 * (a + b - c)), None)
            if least is None:
                assert J.needed(a, b) > a or b > J.most_partner(a)
            else:
                assert J.needed(a, b) == least and b <= J.most_partner(a)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    group = {k: k for link in links for k in link}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    expected = {k: v for k, v in group.items() if any(k in link and link[0] != link[1] for link in links)}
    frame = spark.createDataFrame(links, "a long, b long")
    rows = components(frame).collect()
    assert len(rows) == len(expected) and {r["node"]: r["component"] for r in rows} == expected
    assert components(frame.where("false")).count() == 0


def test_bit_maps_lose_no_pair_that_is_alike():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 1 << 54, n + 200, dtype=np.uint64))
        rng.shuffle(pool)
        a, gone, new = pool[:n], int(rng.integers(0, n)), int(rng.integers(0, 200))
        b = np.concatenate([a[gone:], pool[n : n + new]])
        common, union = len(a) - gone, len(a) + new
        alike = 100 * common >= 75 * union
        kept = J.may_be_alike(J.sketch(a), len(a), J.sketch(b), len(b))
        assert kept or not alike
        assert kept == J.may_be_alike(J.sketch(b), len(b), J.sketch(a), len(a))
        ruled_out += not kept
    assert ruled_out > 1500


def test_large_group_of_near_copies(spark):
    """Each differs from the base by a few words, so lists hold all of them; some also share a passage with strangers."""
    rng = random.Random(9)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(60)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join([f"s{k}-{j}" for j in range(40)] + passage)) for k in range(100)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_tasks_are_handed_small_batches(spark, tmp_path):
    """Whole texts wait several times in a task, so that a batch of 10000 long rows would be hundreds of megabytes an executor."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    before = spark.conf.get(BATCH_CONF)
    docs = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    scratch = Scratch(spark)
    found = scratch.settle(docs.mapInArrow(sizes, "bytes long"), "sizes")
    assert found.agg(F.max("bytes")).first()[0] < 5 << 20 and found.agg(F.sum("bytes")).first()[0] >= 30_000_000
    assert spark.conf.get(BATCH_CONF) == before
    scratch.drop(found)


def _entries(spark, lists):
    rows = [(key, c, 10, 0, 13) for key, classes in lists.items() for c in classes]
    return spark.createDataFrame(rows, "key long, class long, size int, place int, reach long")


def test_exhaustive_round_follows_when_little_is_left(spark):
    """A list of one component is closed; a member outside the least component may meet its whole list."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "node long, component long")
    rest = J._open_lists(_entries(spark, {7: [1, 2, 3], 8: [1, 2, 3, 4, 5], 9: [5, 6]}), labels)
    found = sorted((r["key"], r["class"], r["component"], r["left"]) for r in rest.collect())
    assert found == [(8, 1, 1, 0), (8, 2, 1, 0), (8, 3, 1, 0), (8, 4, 1, 0), (8, 5, 5, 5), (9, 5, 5, 0), (9, 6, 6, 2)]
    assert J._few_left(rest)
    assert J._few_left(rest.where("false"))
    # One hot list of strangers would be compared pair by pair.
    assert not J._few_left(J._open_lists(_entries(spark, {8: list(range(5, 50))}), labels))


def test_rounds_end_when_little_is_left(spark, monkeypatch):
    """Chains of near copies would be linked bit by bit in round after round."""
    rounds = []
    few = J._few_pairs
    monkeypatch.setattr(J, "_few_pairs", lambda lists, turn: rounds.append(turn) or few(lists, turn))
    monkeypatch.setattr(J, "FRUITFUL", 0.0)
    rng = random.Random(2)
    rows = []
    for k in range(60):
        words = [f"c{k}-{j}" for j in range(60)]
        rows.append((2 * k, " ".join(words)))
        words[rng.randrange(60)] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert rounds == [0]


def test_few_links_are_joined_without_a_shuffle(spark):
    """Each round of contraction shuffles nine times, which took most of the time over many small partitions."""
    frame = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(8)
    found = components(frame)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["component"] for r in found.collect()} == {0}


def test_links_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 50)
    rng = random.Random(8)
    chain = list(range(300))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000 + rng.randrange(40), 1000) for _ in range(200)] + [(k, k) for k in range(5)]
    rows = components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {(r["node"], r["component"]) for r in rows if r["node"] < 1000} == {(k, 0) for k in chain}
    assert {r["component"] for r in rows if r["node"] >= 1000} == {1000}


def test_least_nodes():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900):
        u, v = rng.integers(-n, n, n), rng.integers(-n, n, n)
        group = {int(k): int(k) for k in np.concatenate([u, v])}
        for _ in group:
            before = dict(group)
            for a, b in zip(u.tolist(), v.tolist()):
                group[a] = group[b] = min(group[a], group[b])
            if before == group:
                break
        nodes, least = C.least_nodes(u, v)
        assert dict(zip(nodes.tolist(), least.tolist())) == group


def test_encoders_are_freed():
    """Workers carried the pieces that an encoder had met, about 100 MB each, through all later steps."""
    encode = bpe._unit_encoder(vocabulary(BYTE_RANKS), pattern())
    assert bpe._unit_encoder(vocabulary(BYTE_RANKS), pattern()) is encode
    units.release_encoders()
    assert bpe._unit_encoder.cache_info().currsize == 0
    assert bpe._unit_encoder(vocabulary(BYTE_RANKS), pattern()) is not encode
