"""The numpy helpers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rowferry.llm import text as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n.\té日　\xa0'", max_size=30)), max_size=8)


def batch(values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"])


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 40))
def test_chunks_and_words(values, size):
    found, rows = [], 0
    for part, data, offsets in T.chunks(batch(values), size=size):
        starts, ends, row = T.words(data, offsets, T.WORD_BYTE)
        for r in range(part.num_rows):
            found.append([bytes(T.LOWER[data[a:b]]).decode() for a, b, k in zip(starts, ends, row) if k == r])
        rows += part.num_rows
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    assert rows == len(values)
    assert found == [WORD.findall((v or "").translate(lower)) for v in values]


def test_sliced_batches_keep_their_rows():
    whole = batch(["first", None, "second word", "x"]).slice(1, 2)
    data, offsets = T.column_bytes(whole.column("text"))
    assert bytes(data) == b"second word" and offsets.tolist() == [0, 0, 11]


def test_hashes_depend_on_the_bytes_alone():
    data, offsets = T.column_bytes(pa.array(["Abc xy abc", "xy abc  ABC"]))
    starts, ends, _ = T.words(data, offsets, T.WORD_BYTE)
    folded = T.hash_spans(data, starts, ends, T.LOWER)
    assert folded[0] == folded[2] == folded[4] == folded[5] and folded[1] == folded[3] != folded[0]
    assert len(set(T.hash_spans(data, starts, ends).tolist())) == 4
    grams = T.gram_hashes(folded, 2)
    assert grams[0] != grams[1] and grams[1] == T.gram_hashes(folded[3:], 2)[0]
    assert len(T.gram_hashes(folded, 7)) == 0


@settings(max_examples=150, deadline=None)
@given(texts)
def test_units_cover_the_text(values):
    for _, data, offsets in T.chunks(batch(values)):
        cuts = T.unit_offsets(data, offsets)
        assert set(offsets.tolist()) <= set(cuts.tolist()) and np.all(np.diff(cuts) > 0)
        bytes(data).decode()
        for a, b in zip(cuts[:-1], cuts[1:]):
            bytes(data[a:b]).decode()
