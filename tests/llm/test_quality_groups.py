"""Quality verdicts on planted documents: copies, many outliers, small groups."""

import numpy as np
import pandas as pd

from rowferry.llm import quality as Q


def prose(rng):
    words = []
    for k in range(int(rng.integers(80, 300))):
        word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10))))
        words.append((word.capitalize() if k % 9 == 0 else word) + ("." if k % 9 == 8 else ",") * int(k % 9 == 8 or rng.random() < 0.05))
    return " ".join(words[:40]) + "\n" + " ".join(words[40:])


def junk(rng):
    return "\n".join(f"#{rng.integers(1e9)}|$$%&" + "|*" * int(rng.integers(3, 9)) for _ in range(int(rng.integers(60, 90))))


def verdicts(spark, rows):
    """Of each mark: the share of its rows that is kept. Rows are (mark, lang, source, text)."""
    frame = spark.createDataFrame([(f"{mark}-{k}", text, lang, source) for k, (mark, lang, source, text) in enumerate(rows)], "doc_id string, text string, lang string, source string")
    found = Q.judge(frame.repartition(4)).select("doc_id", "base_failed", "kept").toPandas()
    assert len(found) == len(rows) and not found["base_failed"].any()
    return found.groupby(found["doc_id"].str.split("-").str[0])["kept"].mean().to_dict()


def test_copies_weigh_no_more_than_their_text(spark):
    rng = np.random.default_rng(1)
    clean = [("clean", "en", "hot", prose(rng)) for _ in range(200)]
    rows = clean + [("copy", "en", "hot", clean[0][3])] * 500 + [("junk", "en", "hot", junk(rng)) for _ in range(20)]
    found = verdicts(spark, rows)
    assert found["clean"] >= 0.99 and found["copy"] == 1 and found["junk"] == 0


def test_outliers_up_to_nearly_half_are_rejected(spark):
    rng = np.random.default_rng(3)
    frames = []
    for share in (0.24, 0.34, 0.45):
        n = int(1000 * share)
        good = rng.multivariate_normal([5, 0.9, -4, -4, 3], np.diag([0.3, 0.01, 0.2, 0.2, 0.1]) ** 2, 1000 - n)
        bad = rng.multivariate_normal([20, 0.5, -8, -0.5, 0.5], np.diag([1, 0.01, 0.2, 0.2, 0.1]) ** 2, n)
        rows = pd.DataFrame(np.vstack([good, bad]), columns=Q.STATISTICS)
        frames.append(rows.assign(lang="en", source=str(share), bad=np.arange(1000) >= 1000 - n))
    rows = pd.concat(frames)
    found = Q.robust_estimates(spark.createDataFrame(rows.drop(columns="bad"))).toPandas().set_index("source")
    for source, own in rows.groupby("source"):
        r = found.loc[source]
        inverse = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(5)] for i in range(5)])
        off = own[Q.STATISTICS].to_numpy() - r[[f"c{k}" for k in range(5)]].to_numpy(float)
        rejected = np.einsum("ni,ij,nj->n", off, inverse, off) / r["scale"] > Q.CUTOFF * 5
        assert rejected[own["bad"]].all() and not rejected[~own["bad"]].any(), source


def test_junk_of_a_third_is_rejected(spark):
    rng = np.random.default_rng(4)
    rows = [("clean", "en", "hot", prose(rng)) for _ in range(200)] + [("junk", "en", "hot", junk(rng)) for _ in range(100)]
    found = verdicts(spark, rows)
    assert found["clean"] >= 0.99 and found["junk"] == 0


def test_small_groups_and_languages_are_judged(spark):
    rng = np.random.default_rng(5)
    rows = [("clean", "en", f"s{k % 9}", prose(rng)) for k in range(90)] + [("junk", "en", f"s{k}", junk(rng)) for k in range(9)]
    rows += [("rare", lang, "s1", prose(rng)) for lang in ("fr", None) for _ in range(10)] + [("odd", "fr", None, junk(rng))]
    found = verdicts(spark, rows)
    assert found["clean"] >= 0.98 and found["rare"] >= 0.95 and found["junk"] == found["odd"] == 0


def test_an_estimate_does_not_depend_on_other_groups(spark):
    rng = np.random.default_rng(6)
    # Correlated, skewed and half mixed: the slow one. The others have settled after a step or two.
    slow = np.exp(rng.multivariate_normal(np.zeros(5), 0.9 * np.ones((5, 5)) + 0.1 * np.eye(5), 3000))
    slow[:1300] += [0, 1, 2, 3, 4]
    alone = pd.DataFrame(slow, columns=Q.STATISTICS).assign(lang="en", source="slow")
    quick = [pd.DataFrame(rng.normal(size=(70, 5)) * 1e-3, columns=Q.STATISTICS).assign(lang="en", source=f"s{k}") for k in range(40)]
    columns = [f"c{k}" for k in range(5)] + ["logdet", "scale"]
    one = Q.robust_estimates(spark.createDataFrame(alone)).select(*columns).first()
    both = Q.robust_estimates(spark.createDataFrame(pd.concat([alone, *quick]))).where("source = 'slow'").select(*columns).first()
    assert np.allclose(one, both, rtol=1e-9)


def test_starts_hold_no_list_of_a_group(spark, monkeypatch):
    def exact(*_):
        raise AssertionError("the exact median gathers a group's values")

    monkeypatch.setattr(Q.F, "median", exact)
    rows = pd.DataFrame(np.random.default_rng(7).normal(size=(80, 5)), columns=Q.STATISTICS).assign(lang="en", source="s")
    assert Q.robust_estimates(spark.createDataFrame(rows)).count() == 1
