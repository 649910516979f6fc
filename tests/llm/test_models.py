"""Language identification, toxicity and quality rules."""

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rowferry.llm import language as L
from rowferry.llm import quality as Q
from rowferry.llm import toxicity as T
from rowferry.llm.queries import op5_language_id, op6_toxicity, op10_quality
from rowferry.llm.text import column_bytes


def plain_grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    found = collections.Counter()
    signs = "_".join(["", *words, ""]) if words else ""
    for size in (1, 2, 3):
        for k in range(len(signs) - size + 1):
            gram = signs[k : k + size]
            if "_" not in gram[1:-1] and gram.strip("_"):
                found[gram] += 1
    return found


def coded(gram):
    code = [0 if c == "_" else int(L.letter_codes()[ord(c)]) for c in gram]
    mark = (1 << 18) - 1
    a, b, c = [mark] * (3 - len(code)) + code
    return a << 36 | b << 18 | c


@pytest.mark.parametrize("texts", [["The cat. Ça va?", "", "x", "12 !", "日本 語 aaa aaa"], ["a" * 3000, "b c", "É é"]])
def test_grams(texts):
    data, offsets = column_bytes(pa.array(texts))
    grams, row = L.grams(data, offsets)
    for k, text in enumerate(texts):
        expected = {coded(g): n for g, n in plain_grams(text).items()}
        assert collections.Counter(grams[row == k].tolist()) == expected
    top, owner, rank = L.top_grams(data, offsets, 5)
    for k, text in enumerate(texts):
        own = sorted(((-n, coded(g)) for g, n in plain_grams(text).items()))[:5]
        assert top[owner == k].tolist() == [g for _, g in own] and rank[owner == k].tolist() == list(range(len(own)))


def test_profiles_and_distance(spark):
    rows = [("en", "the cat and the dog"), ("en", "this and that"), ("fr", "le chat et le chien"), (None, "zzz"), ("fr", None)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    profiles = L.learn_profiles(frame, 20).collect()
    for lang in ("en", "fr"):
        total = sum((plain_grams(t) for k, t in rows if k == lang and t), collections.Counter())
        expected = [g for _, g in sorted((-n, coded(g)) for g, n in total.items())[:20]]
        assert [r["gram"] for r in sorted(profiles, key=lambda r: r["rank"]) if r["lang"] == lang] == expected
    text = "the chat and a zebra"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 !")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in L.predict_languages(docs, L.learn_profiles(frame, 20), size=20).collect()}
    own = [g for _, g in sorted((-n, coded(g)) for g, n in plain_grams(text).items())[:20]]
    distance = {}
    for lang in ("en", "fr"):
        ranks = {r["gram"]: r["rank"] for r in profiles if r["lang"] == lang}
        distance[lang] = sum(abs(ranks[g] - k) if g in ranks else 20 for k, g in enumerate(own))
    best = min(distance, key=lambda k: (distance[k], k))
    assert found[1]["lang_pred"] == best and found[1]["score"] == pytest.approx(1 - distance[best] / (20 * len(own)))
    assert found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[2]["score"] == found[3]["score"] == 0


def test_language_edge_cases(docs, no_docs):
    profiles = L.learn_profiles(docs)
    rows = {(r["doc_id"], r["lang_pred"]) for r in L.predict_languages(docs, profiles).collect()}
    assert (3, "und") in rows and (4, "und") in rows and (7, "en") in rows
    assert L.predict_languages(no_docs, profiles).count() == 0
    nothing = L.predict_languages(docs, L.learn_profiles(no_docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_language_accuracy(spark, sf_dir, real):
    langs = {r["doc_id"]: r["lang"] for r in real.collect()}
    rows = op5_language_id(spark, sf_dir).collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95


def toxic_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"word{k}" for k in range(300)]
    out = []
    for k in range(n):
        sentences = [list(rng.choice(words, 8)) for _ in range(rng.integers(2, 10))]
        bad = k % 4 == 0
        if bad:
            sentences[int(rng.integers(len(sentences)))][2] = rng.choice(["nasty", "grumpify", "grumpest"])
        out.append((k, ". ".join(" ".join(s) for s in sentences), int(bad)))
    return out


def test_toxicity_finds_documents_and_sentences(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    scored = T.score_texts(docs, model, ("doc_id", "text")).collect()
    for r in scored:
        truth = rows[r["doc_id"]][2]
        assert (r["score"] >= 0.5) == bool(truth), r
        for s in r["offending"]:
            assert re.search("nasty|grump", r["text"][s["start"] : s["end"]])
    # Unseen ends of a seen beginning.
    fresh = spark.createDataFrame([(1, "word1 grumpland word3"), (2, "word1 word2")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.5 for r in T.score_texts(fresh, model).collect()} == {1: True, 2: False}


def test_toxicity_score_is_the_noisy_or(spark):
    data, offsets = column_bytes(pa.array(["bad bad. good! bad ugly\nfine", ""]))
    hashes, sentence, starts, ends, row = T.sentences(data, offsets)
    assert len(starts) == 4 and row.tolist() == [0] * 4
    features = T.sentences(*column_bytes(pa.array(["bad"])))[0]
    model = T.Model(features[:1], np.array([3.0]), -2.0)
    chance = 1 / (1 + np.exp(2 - 3 * np.array([1, 0, 1, 0])))
    frame = spark.createDataFrame([(1, "bad bad. good! bad ugly\nfine"), (2, ""), (3, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in T.score_texts(frame, model).collect()}
    assert scores[1] == pytest.approx(1 - np.prod(1 - chance)) and scores[2] == scores[3] == 0


def test_toxicity_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (8, 0), (8, 1)], "doc_id long, toxic int")
    for model in (T.train(docs, labels), T.train(docs, labels.where("false")), T.train(no_docs, labels), T.train(docs, labels.where("toxic = 1"))):
        assert T.score_texts(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
        assert T.score_texts(no_docs, model).count() == 0


def test_toxicity_query(spark, sf_dir, real):
    rows = op6_toxicity(spark, sf_dir).collect()
    assert len(rows) == real.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, real):
    hard = spark.createDataFrame(
        [(1, "a b c a b c a\na b c\na b c\n\n \na", "en", "s"), (2, "a a a a", "en", "s"), (3, "# é% <日本>|\n# é% <日本>|\n", None, None)],
        "doc_id long, text string, lang string, source string",
    )
    for frame in (hard, docs.select("doc_id", "text", "lang", "source"), real):
        counts = Q.count_texts(frame, ("doc_id", "text"))
        for r in counts.collect():
            assert tuple(r[c] for c in Q.COUNTS) == plain_counts(r["text"]), r["doc_id"]


def test_quality_edge_cases(docs, no_docs):
    rows = Q.judge(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    assert Q.judge(no_docs).count() == 0


def test_robust_estimate_ignores_outliers(spark):
    rng = np.random.default_rng(2)
    cov = np.array([[2, 0.8, 0, 0, 0], [0.8, 1, 0, 0, 0], [0, 0, 1, 0.3, 0], [0, 0, 0.3, 1, 0], [0, 0, 0, 0, 3.0]])
    good = rng.multivariate_normal([1, 2, 3, 4, 5], cov, 1500)
    bad = rng.multivariate_normal([30, -20, 9, 9, 9], np.eye(5), 250)
    rows = pd.DataFrame(np.vstack([good, bad]), columns=Q.STATISTICS).assign(lang="en", source="s")
    few = rows.head(10).assign(source="few")
    frame = spark.createDataFrame(pd.concat([rows, few]))
    r = Q.robust_estimates(frame).collect()
    assert len(r) == 1
    assert np.allclose([r[0][f"c{k}"] for k in range(5)], [1, 2, 3, 4, 5], atol=0.25)
    inverse = np.array([[r[0][f"p{min(i, j)}_{max(i, j)}"] for j in range(5)] for i in range(5)])
    centre = np.array([r[0][f"c{k}"] for k in range(5)])
    distance = np.einsum("ni,ij,nj->n", rows[Q.STATISTICS] - centre, inverse, rows[Q.STATISTICS] - centre) / r[0]["scale"]
    assert (distance[1500:] > Q.CUTOFF * 5).all() and (distance[:1500] < Q.CUTOFF * 5).all()


def test_quality_query(spark, sf_dir, real):
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    rows = op10_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert tuple(r[c] for c in Q.COUNTS) == counts and r["base_failed"] == failed and not (failed and r["kept"])
