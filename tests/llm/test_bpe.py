import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from rowferry.llm.bpe import decode_ids, encode_texts, id_digests, load_ranks, merge_ranks, pair_ranks, round_trips
from rowferry.llm.tokens import pattern, vocabulary

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(frame, library):
    encoded = encode_texts(frame, RANKS, pattern(), ("doc_id", "text"))
    rows = decode_ids(encoded, RANKS, ("doc_id", "text", "ids")).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or ""), r["doc_id"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    digests = round_trips(frame, RANKS, pattern(), ("doc_id", "text"))
    found = digests.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    stepwise = id_digests(encoded.select("doc_id", "ids"), ("doc_id",))
    assert sorted(map(repr, stepwise.collect())) == sorted(map(repr, digests.select("doc_id", "n_tokens", "ids_sha256").collect()))


def test_edge_cases(docs, no_docs, library):
    check(docs, library)
    check(no_docs, library)


def test_real_rows(real, library):
    check(real, library)


def test_spaces_and_control_signs(spark, library):
    rng = random.Random(3)
    signs = "ab \n\t\r\x0b\x0c\x1c\x1f\x85\xa0     　​.,'sé日1<|>"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(800)] + ["don't I'LL 's", "<|endoftext|>"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), library)


def test_one_long_pre_token(library):
    ranks = load_ranks(RANKS)
    rng = random.Random(1)
    for piece in ("a" * 5000, "".join(rng.choices("abcdeé日", k=20_000))):
        assert merge_ranks(piece.encode(), ranks, pair_ranks(ranks)) == library._core_bpe.encode_single_piece(piece.encode())
