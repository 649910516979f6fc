import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rowferry.llm import units
from rowferry.llm.tokens import read_tokens, token_digests, vocabulary, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def check(spark, tmp_path, docs, tokenizer):
    path = str(tmp_path / "tokens")
    write_tokens(docs, path)
    rows = read_tokens(spark, path).collect()
    given = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    texts = {}
    for known, i, text in given:
        texts.setdefault(i if known else None, []).append(tokenizer.encode(text, add_special_tokens=False).ids + [1])
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i if known else None for known, i, _ in given]
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        start += len(r["ids"])
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_digests(read_tokens(spark, path)).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}


def test_edge_cases(spark, tmp_path, docs, tokenizer):
    check(spark, tmp_path, docs, tokenizer)


def test_real_rows(spark, tmp_path, real, tokenizer):
    check(spark, tmp_path, real, tokenizer)


def test_empty_table(spark, tmp_path, no_docs):
    write_tokens(no_docs, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_one_id_is_found_by_the_filter(spark, tmp_path, real):
    path = str(tmp_path / "tokens")
    write_tokens(real, path)
    one = read_tokens(spark, path).where("doc_id = 77")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in one._jdf.queryExecution().toString()


def test_remembered_pieces_are_bounded_and_made_once():
    made = []
    filled = units.Filled(lambda x: made.append(x) or x.encode(), size=10)
    pieces = [f"p{k}" for k in range(35)]
    assert [filled[p] for p in pieces] == [p.encode() for p in pieces] and made == pieces
    assert len(filled) <= 10 and len(filled.old) <= 10
    assert filled["p34"] == b"p34" and filled["p25"] == b"p25" and made == pieces
    long = "x" * 65
    assert filled[long] == filled[long] == long.encode() and made == [*pieces, long, long]


def test_many_pieces_are_remembered_like_single_ones():
    pieces = [b"%d" % k for k in range(35)] + [b"x" * 65]
    one, many = units.Remembered(10), units.Remembered(10)
    for p in pieces:
        one.put(p, p)
    many.put_all(pieces, list(pieces))
    assert (one.young, one.old) == (many.young, many.old)
    assert many.get_all(pieces)[-16:] == [*pieces[20:35], None]
