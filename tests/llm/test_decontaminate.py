import re

import pytest

from rowferry.llm.decontaminate import find_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    """n_words, n_hit, ids of items with occurring windows."""
    words = WORD.findall((text or "").lower())
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD.findall((item or "").lower())
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(item_id)
    return len(words), len(hit), found


ITEMS = [
    (1, "two three four five six seven eight nine ten eleven"),
    (2, "Short"),
    (3, None),
    (4, ""),
    (5, "on a mat and the cat sat on a mat and the"),
    (6, "equal"),
    (6, "six seven"),
    (None, "without an id"),
    (7, "日本語 \U0001f642"),
    (8, "three four five six seven eight nine ten eleven TWELVE thirteen"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_all_windows(spark, docs, limit):
    items = spark.createDataFrame([(*i, "extra") for i in ITEMS], "item_id long, text string, hits string")
    rows = find_hits(docs, items, ("doc_id", "text"), max_local_bytes=limit).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = brute(r["text"], ITEMS)
        assert (r["n_words"], r["n_hit"], {h["item_id"] for h in r["hits"]}) == expected, r["doc_id"]
        words = WORD.findall((r["text"] or "").lower())
        texts = [t for i in {h["item_id"] for h in r["hits"]} for k, t in ITEMS if k == i]
        for h in r["hits"][:20]:
            run = " ".join(words[h["start"] : h["end"]])
            assert any(run in " ".join(WORD.findall((t or "").lower())) for t in texts)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_both_ways_agree_on_real_rows(spark, real, sf_dir, limit):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    sample = real.where("doc_id < 60")
    for r in find_hits(sample, items, ("doc_id", "text"), max_local_bytes=limit).collect():
        assert (r["n_words"], r["n_hit"], {h["item_id"] for h in r["hits"]}) == brute(r["text"], pairs)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_empty_tables(spark, docs, no_docs, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_hits(no_docs, items, max_local_bytes=limit).count() == 0
    assert find_hits(docs, items.where("false"), max_local_bytes=limit).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_item_ids_keep_their_type(spark, docs, kind, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    found = find_hits(docs, items, ("doc_id", "text"), max_local_bytes=limit)
    assert found.schema["hits"].dataType.elementType["item_id"].dataType == items.schema["item_id"].dataType
    own = str if kind == "string" else int
    pairs = [(None if i is None else own(i), text) for i, text in ITEMS]
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], {h["item_id"] for h in r["hits"]}) == brute(r["text"], pairs), r["doc_id"]


@pytest.mark.parametrize("only", ["item_id = 2", "item_id = 5", "item_id in (2, 8)", "item_id = 4"])
def test_benchmarks_of_few_lengths(spark, docs, only):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").where(only)
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    for r in find_hits(docs, items, ("doc_id", "text"), max_local_bytes=0).collect():
        assert (r["n_words"], r["n_hit"], {h["item_id"] for h in r["hits"]}) == brute(r["text"], pairs), r["doc_id"]
