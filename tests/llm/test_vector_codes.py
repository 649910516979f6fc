import hashlib
import math
import random

import numpy as np
import pytest

from rowferry.llm import queries as llm
from rowferry.llm.vector_codes import code_vectors, exact_products, limbs

BAD = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]


def brute(rows):
    """The contract in Python's whole numbers: rows of (vec_id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    whole = [[math.floor(x) * 4096 if abs(x) >= 2.0**53 else math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    m = width // 8
    parts = [[w[p * m : (p + 1) * m] for w in whole] for p in range(8)]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[parts[p][k] for k in start] for p in range(8)]

    def assign():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        return [[min((far(v, c), k) for k, c in enumerate(books[p])) for v in parts[p]] for p in range(8)]

    for _ in range(6):
        found = assign()
        for p in range(8):
            for k in range(len(books[p])):
                own = [v for v, (_, code) in zip(parts[p], found[p]) if code == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(found[p][k][0] for p in range(8)) for k in range(len(kept))]
    totals = {}
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    fit = lambda x: x if x < 1 << 63 else None
    return [
        (i, "".join(f"{found[p][k][1]:02x}" for p in range(8)), fit(errors[k]), fit(totals[label]), digest) for k, (i, _, label) in enumerate(kept)
    ]


@pytest.mark.parametrize("top", [1, 4096, 1 << 24, 1 << 28, 1 << 40, 1 << 100])
def test_exact_products(top):
    random.seed(top)
    draw = lambda n: [[random.randint(-top, top) for _ in range(8)] for _ in range(n)]
    a, b = draw(20), draw(16)
    kind = np.int64 if top < 1 << 28 else object
    found = exact_products(np.array(a, kind), np.array(b, kind))
    assert found.tolist() == [[sum(x * y for x, y in zip(u, v)) for v in b] for u in a]
    cut = limbs(np.array(a, kind), 24)
    assert [[int(sum(int(c[i][j]) << 24 * k for k, c in enumerate(cut))) for j in range(8)] for i in range(20)] == a


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1e3), ("double", 1e9), ("float", 1e30)])
def test_against_brute(spark, kind, scale):
    rng = np.random.default_rng(3)
    kinds = np.float32 if kind == "float" else np.float64
    rows = [(i, [float(x) for x in (rng.normal(size=16) * scale).astype(kinds)], int(i % 3) if i % 5 else None) for i in range(90)]
    rows += [(200 + i, v, 1) for i, v in enumerate(BAD)] + [(300, rows[0][1], 1)] * 40
    assert sorted(tuple(r) for r in code_vectors(frame(spark, rows, kind)).collect()) == sorted(brute(rows))


def test_edge_cases(spark):
    """Few rows, rows without an id, short vectors, ties, extra columns, no rows."""
    rows = [(None, [1.0] * 9, None), (5, [0.0] * 9, 1), (5, [0.0] * 9, 1), (7, [0.5, -0.5], 1), (8, [], 2)]
    given = frame(spark, rows)
    for name in ("code", "error", "key", "of", "vector"):
        given = given.selectExpr("*", f"'x' AS {name}")
    assert sorted(map(repr, map(tuple, code_vectors(given).collect()))) == sorted(map(repr, brute(rows)))
    assert code_vectors(frame(spark, [])).collect() == []
    assert code_vectors(frame(spark, [(1, None, 1), (2, [None], 1)])).collect() == []


def test_query_against_brute(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = llm.QUERIES["op13_vector_codes"](spark, sf_dir)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))
