"""The registered queries against their SQL, and the pipeline stage by stage."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from rowferry.llm import queries as llm
from rowferry.llm.decontaminate import find_hits
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import plain
from tools.check_queries import NAMES, bag


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in llm.QUERIES)] == []
    assert {"pipeline", *llm.QUERIES} <= set(entry_point.queries())
    assert set(llm.SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query(spark, db, sf_dir, name):
    df = llm.QUERIES[name](spark, sf_dir)
    found = db.execute(llm.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, found.fetchall())


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(number)))
        docs_after = spark.read.parquet(str(tmp_path / str(number)))
        after = {r["doc_id"]: r for r in docs_after.collect()}
        if name != "tokens":
            assert docs_after.columns == docs.columns
        if name == "toxicity":
            marked = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
            assert len(marked & set(after)) > 0.95 * len(marked) and set(after) <= set(before)
        elif name == "near_duplicates":
            groups = brute([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, size, least in groups if i == least}
        elif name == "decontaminate":
            clean = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0")
            assert set(after) == {r["doc_id"] for r in clean.collect()}
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                spans = plain(before[i]["text"])
                assert (r["text"] == before[i]["text"]) == (not spans)
                assert not spans or r["n_chars"] == len(r["text"])
        else:
            assert set(after) == set(before)
            assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in after.values())
        docs = docs_after
    assert re.fullmatch("exact", docs_after.columns[-1]) and set(after) < set(given)


def test_pipeline_edge_cases(spark, sf_dir, real, docs):
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "ids", "spans", "hits", "key")
    for _, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.where("false")):
            out = stage(spark, rows, sf_dir)
            assert out.count() <= rows.count()
    kept = corpus_pipeline.near_duplicates(spark, odd, sf_dir)
    assert sorted((r["doc_id"] for r in kept.select("doc_id").distinct().collect()), key=str) == [1, 10, 2, 3, 4, 5, 6, 7, 8, None]
