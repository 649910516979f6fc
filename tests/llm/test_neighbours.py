import numpy as np
import pytest
from pyspark.sql import functions as F

from rowferry.llm import neighbours, queries as llm
from rowferry.llm.neighbours import nearest_vectors


def brute(rows, k=20, every=20):
    """{query_id: [(vec_id, score), ...]} by comparing all; rows of (vec_id, vector)."""
    kept = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in kept), default=0)
    table = np.array([[*v, *[0.0] * (width - len(v))] for _, v in kept], np.float64)
    out = {}
    for n, (i, _) in enumerate(kept):
        if i % every == 0:
            scores = table @ table[n]
            order = sorted((-s, j) for s, (j, _) in zip(scores.tolist(), kept) if j != i)
            out[i] = [(j, -s) for s, j in order[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, expected):
    return sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in expected.items()) / sum(map(len, expected.values()))


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def search(df, **more):
    return answers(nearest_vectors(df, F.col("vec_id") % 20 == 0, **more))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_query(spark, sf_dir, folder):
    path = f"{sf_dir}/../{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found, expected = answers(llm.QUERIES["op11_nearest_vectors"](spark, path)), brute(rows)
    assert set(found) == set(expected) and all(len(found[q]) == len(expected[q]) for q in expected)
    assert recall(found, expected) >= 0.93
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in found.items():
        assert q not in {i for i, _ in near} and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert np.allclose([s for _, s in near], [vectors[i] @ vectors[q] for i, _ in near], rtol=1e-12, atol=1e-15)


def test_a_third_of_all_is_one_vector(spark):
    """Equal vectors: the smallest ids come first; near copies of one vector fill lists of several pieces."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(i, [float(x) for x in (one if i % 3 == 0 else rng.normal(size=16) if i % 3 == 1 else one + rng.normal(size=16) * 1e-3)]) for i in range(3000)]
    pieces = neighbours.PIECE, neighbours.MEETING
    neighbours.PIECE, neighbours.MEETING = 100, 7
    try:
        found = search(frame(spark, rows, "double"))
    finally:
        neighbours.PIECE, neighbours.MEETING = pieces
    expected = brute(rows)
    assert recall(found, expected) >= 0.93
    for q in found:
        if q % 3 == 0:
            own = float(one @ one)
            larger = [i for i, s in expected[q] if s > own * (1 + 1e-12)]
            assert [i for i, s in found[q] if abs(s - own) < 1e-9 * own] == [i for i in range(0, 3000, 3) if i != q][: 20 - len([i for i in larger if i in dict(found[q])])]


def test_lengths_differ(spark):
    """The largest inner product, not the smallest angle: long vectors win."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.uniform(0.2, 3)]) for i in range(2000)]
    found, expected = search(frame(spark, rows, "double")), brute(rows)
    assert recall(found, expected) >= 0.9


def test_edge_cases(spark):
    """Unusable vectors, few rows, repeated rows, shorter vectors, one id with two vectors, extra columns."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0])]
    rows += [(6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [-1.0, 2.0]), (8, [1.0, 0.0]), (20, []), (40, [3.0, 1.0, 2.0])]
    given = frame(spark, rows)
    for name in ("mark", "list", "lists", "id", "vector", "rank", "piece"):
        given = given.withColumn(name, F.lit("x"))
    assert search(given) == {0: [(40, 3.0), (8, 1.0), (1, 0.5), (7, -1.0)], 40: [(0, 3.0), (8, 3.0), (1, 1.5), (7, -1.0)]}
    assert search(frame(spark, [(0, [1.0]), (9, [1.0]), (9, [2.0])])) == {0: [(9, 2.0), (9, 1.0)]}
    assert search(frame(spark, [(0, [1.0])])) == {} == search(frame(spark, [])) == search(frame(spark, [(1, [1.0]), (2, [1.0])]))
    assert search(frame(spark, rows), k=1) == {0: [(40, 3.0)], 40: [(0, 3.0)]}
