"""Token ids in ORC files, sorted by document id.

Tokens are written once: an integer array a row, run-length encoded in
stripes, with row indexes and Bloom filters on the document id, so that a
reader takes any stripes in parallel and skips those without a wanted id.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.llm.text import chunks
from rowferry.llm.units import Filled, UnitEncoder

END_ID = 1
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: Bytes of text encoded at once: each distinct piece among them is looked up once.
ENCODED_BYTES = 1 << 22


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern that splits text into pre-tokens before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Pieces of these signs are lower-cased and composed sign by sign, and fall into runs of letters, single digits and the rest.
PLAIN = re.compile(r"[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=2)
def _text_encoder(path: str) -> UnitEncoder:
    """The tokenizer of a file, as an encoder that keeps what it knows while its worker lives.

    The common pieces, without apostrophes and special signs, are split as the
    file's pre-tokenizer splits them and given to its model part by part; all
    others go through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge, signs = tokenizer.model.tokenize, byte_signs()
    # Other pieces are encoded in lines of many and told apart by their place.
    line = 2000

    def merged(text: str) -> bytes:
        spelled = text if text.isascii() else "".join(signs[b] for b in text.encode())
        return array("i", [t.id for t in merge(spelled)]).tobytes()

    part = Filled(merged).__getitem__

    def encode(pieces: list[bytes]) -> list[bytes]:
        texts = [x.decode().strip(" \t\n\v\f\r") for x in pieces]
        out: list[bytes] = [b""] * len(texts)
        odd = []
        for k, text in enumerate(texts):
            if text.isascii() and text.isalpha():
                out[k] = part(text.lower())
            elif PLAIN.fullmatch(text):
                out[k] = b"".join(map(part, PARTS.findall(text.lower())))
            else:
                odd.append(k)
        for begin in range(0, len(odd), line):
            own = odd[begin : begin + line]
            found = tokenizer.encode("\n".join(texts[k] for k in own), add_special_tokens=False)
            length = np.fromiter((len(texts[k]) for k in own), np.int64, len(own))
            starts = np.cumsum(length + 1) - length - 1
            ids = np.array(found.ids, np.int32)
            place = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            cuts = np.append(np.searchsorted(place, starts), len(ids))
            for k, a, b in zip(own, cuts[:-1], cuts[1:]):
                out[k] = ids[a:b].tobytes()
        return out

    return UnitEncoder(encode)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", id_column: str = "doc_id") -> None:
    """Encode whole texts, an end id after each, into ORC files in ascending document id (nulls first).

    Texts are dealt by ranges of ids before they are encoded, so ids cross no
    shuffle. A row has doc_id, file (the number of its range), offset (ids
    before it in its file), n_tokens and ids. A null text is empty; rows of one
    id stand together, each for itself; extra columns are left out.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        file = TaskContext.get().partitionId()
        encode = _text_encoder(vocabulary(tokenizer) if "/" not in tokenizer else tokenizer)
        total = 0
        for batch in batches:
            for part, data, offsets in chunks(batch, size=ENCODED_BYTES):
                ids, ends = encode(data, offsets)
                ids = np.insert(ids, ends[1:], END_ID)
                ends = ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.full(part.num_rows, file, np.int32)),
                        pa.array(ends[:-1] + total),
                        pa.array(np.diff(ends)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False))),
                    ],
                    ["doc_id", "file", "offset", "n_tokens", "ids"],
                )
                total += int(ends[-1])

    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.repartitionByRange(ranges, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id")
        .mapInArrow(task, f"doc_id {kind}, file int, offset long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); start counts the ids of all documents before.

    The totals of the ranges come from the n_tokens column alone; there is one
    number a file, whose running sum is added to the offsets within the file.
    """
    tokens = spark.read.orc(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = tokens.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row a file, as many as there were ranges.
    return tokens.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, n_tokens, ids)."""

    def task(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            cuts = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(task, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
