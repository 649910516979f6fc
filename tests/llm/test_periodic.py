import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rowferry.llm import queries as llm
from rowferry.llm.periodic import periodic_runs, word_runs


def brute(given, length=6, times=4):
    """Runs of a list of words by the definition."""
    n, found = len(given), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if given[i] != given[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and given[i] == given[i + q]:
                i += 1
            if i + q - start >= max(length, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(given, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(given) if i not in gone)


def plant(doc_id, given):
    h, n = zlib.crc32(str(doc_id).encode()), len(given)
    if h % 10 or not n:
        return given
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [given[i if i < a else a + (i - a) % p] for i in range(n)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("letters, length, times", [("ab", 6, 4), ("abc", 6, 4), ("ab", 3, 2), ("abcd", 4, 3), ("a", 6, 4)])
def test_runs_of_random_rows(letters, length, times):
    random.seed(len(letters) * 100 + times)
    for _ in range(150):
        rows = []
        for _ in range(random.randint(1, 4)):
            given = random.choices(letters, k=random.randint(0, 60))
            while random.random() < 0.7 and given:
                a, p = random.randrange(len(given)), random.randint(1, 5)
                given[a:a] = given[a : a + p] * random.randint(2, 9)
            rows.append(given)
        code = np.array([ord(c) for r in rows for c in r], np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        found = sorted(zip(*(x.tolist() for x in word_runs(code, row, len(rows), length, times))))
        assert found == [(k, *run) for k, r in enumerate(rows) for run in brute(r, length, times)]


def test_a_long_period(spark):
    """A stretch of one word, and one of a long period, in long texts."""
    many = " ".join(f"w{i}" for i in range(5000))
    frame = spark.createDataFrame([(1, "x " + "a " * 30_000 + "y"), (2, f"{many} {many} {many} {many} end")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic_runs(frame).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(1, 30_000, 1)] and found[1]["collapsed"] == "x a y"
    assert [tuple(x) for x in found[2]["runs"]] == [(0, 20_000, 5000)] and found[2]["collapsed"] == f"{many} end"


def test_edge_cases(docs, no_docs):
    found = periodic_runs(docs, ("doc_id", "score")).collect()
    assert len(found) == docs.count()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in found:
        text = next(t for i, t in texts if i == r["doc_id"])
        assert r["score"] == "extra" and r["n_words"] == len(split(text))
        if r["n_words"] < 1000:
            runs = brute(split(text))
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(split(text), runs)
        else:
            assert [x["period"] for x in r["runs"]] == [7] and len(r["collapsed"].split()) == 7
    assert periodic_runs(no_docs).count() == 0


def test_query(spark, sf_dir, real):
    found = {r["doc_id"]: r for r in llm.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    given = {r["doc_id"]: plant(r["doc_id"], split(r["text"])) for r in real.collect()}
    assert set(found) == set(given) and sum(r["n_runs"] > 0 for r in found.values()) > 5
    for i, text in given.items():
        runs, r = brute(text), found[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(text, runs).encode()).hexdigest()


def test_query_edge_cases(spark, docs, no_docs, tmp_path):
    for name, rows in (("some", docs), ("none", no_docs)):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = llm.QUERIES["op12_periodic_runs"](spark, str(tmp_path / name)).collect()
        assert len(found) == rows.count() and all(r["runs_sha256"] and r["collapsed_sha256"] for r in found)
