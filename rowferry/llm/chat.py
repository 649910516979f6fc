"""Chat formatting by columnar byte assembly.

A turn is ``### role``, a line end, the text, ``</turn>`` and a line end.
Inside roles and texts the control strings are escaped, so they stand only
where the template put them. The bytes of a chunk of turns are laid out at
once: the lengths of all segments give offsets, the offsets give the place of
every byte, and headers and contents are copied into one buffer that becomes
the Arrow column. Turns are dealt to tasks by ranges of conversation and turn,
and a conversation is cut into pieces at the ends of ranges and chunks, so no
task formats a whole long one; only its digest is made in sequence.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.text import chunks, column_bytes
from rowferry.session import settled as settle

# Fixed values of the template.
HEAD = b"### "
LINE = b"\n"
END = b"</turn>\n"
ESCAPES = (("\\", "\\\\"), ("###", "\\h\\h\\h"), ("</turn>", "\\l/turn>"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
BACK = {"\\": "\\", "h": "#", "l": "<", "n": "\n"}
TURN = re.compile(r"### (.*?)\n(.*?)</turn>\n", re.S)
LEARNED_ROLE = "assistant"
PIECE_BYTES = 4 << 20


def escaped(column: pa.Array, escapes=ESCAPES) -> pa.Array:
    column = column.fill_null("")
    for plain, safe in escapes:
        column = pc.replace_substring(column, plain, safe)
    return column


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text) if "\\" in text else text


def assemble(segments: list[bytes | tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' segments in one buffer, and the place of each (rows x segments + 1).

    A segment is a constant, or the bytes and row offsets of a column.
    """
    length = np.empty((rows, len(segments)), np.int64)
    for k, s in enumerate(segments):
        length[:, k] = len(s) if isinstance(s, bytes) else np.diff(s[1])
    places = np.concatenate([[0], np.cumsum(length.ravel())])
    out = np.empty(places[-1], np.uint8)
    for k, s in enumerate(segments):
        to = places[k : -1 : len(segments)]
        if isinstance(s, bytes):
            out[to[:, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
        else:
            data, offsets = s
            out[np.arange(len(data)) + np.repeat(to - offsets[:-1], length[:, k])] = data
    return out, places


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, text, loss): the formatted conversations in pieces.

    ``loss`` lists the (start, end) code points of a piece that are learned:
    the escaped texts of assistant turns. Turns stand by turn number (nulls
    first), equal numbers by role and text; null roles and texts are empty;
    rows with a null conv_id are one conversation; a conversation's text is its
    pieces in order. Repeated rows are repeated turns; extra columns are left out.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The beginning of a text parts repeated turn numbers in the order of whole texts.
    ranges = turns.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = ranges.sortWithinPartitions("conv_id", "turn", "role", "text")

    def task(batches):
        number = TaskContext.get().partitionId()
        last, piece = object(), 0
        for batch in batches:
            for part, _, _ in chunks(batch, size=PIECE_BYTES):
                n = part.num_rows
                role = escaped(part.column("role"), ROLE_ESCAPES)
                out, places = assemble([HEAD, column_bytes(role), LINE, column_bytes(escaped(part.column("text"))), END], n)
                ids = part.column("conv_id").to_pylist()
                cuts = [0, *(k for k in range(1, n) if ids[k] != ids[k - 1]), n]
                edges = np.array([places[5 * k] for k in cuts])
                points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
                learned = np.flatnonzero(pc.equal(part.column("role").fill_null(""), LEARNED_ROLE).to_numpy(zero_copy_only=False))
                owner = np.searchsorted(cuts, learned, "right") - 1
                base = points[edges[owner]]
                loss = pa.StructArray.from_arrays(
                    [pa.array(points[places[5 * learned + 3]] - base), pa.array(points[places[5 * learned + 4]] - base)], ["start", "end"]
                )
                first = ids[0]
                pieces = [0] * (len(cuts) - 1)
                pieces[0] = piece + 1 if first == last else 0
                last, piece = ids[-1], pieces[-1]
                text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(edges), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id").take(pa.array(cuts[:-1])),
                        pa.array([number] * len(pieces), pa.int32()),
                        pa.array(pieces, pa.int32()),
                        pa.array(np.diff(cuts)),
                        text.cast(pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(cuts))).astype(np.int32)), loss),
                    ],
                    ["conv_id", "range", "piece", "n_turns", "text", "loss"],
                )

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, range int, piece int, n_turns long, text string, loss array<struct<start:long,end:long>>"
    pieces = settle(ordered.mapInArrow(task, schema), "pieces")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    later = counts.withColumn("first", F.sum("n").over(earlier)).where("first > 0")
    p, f = pieces.alias("p"), later.alias("f")
    joined = p.join(f, F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.range") == F.col("f.range")), "left")
    place = (F.col("p.piece") + F.coalesce(F.col("f.first"), F.lit(0))).cast("int").alias("piece")
    return joined.select("p.conv_id", place, "p.n_turns", "p.text", "p.loss")


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say: turns, learned text and lengths of each conversation."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.select("conv_id", "piece", "text", "loss").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "piece")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def task(batches):
        state, done = None, []

        def close():
            conv_id, n, said, learned_chars, learned, chars = state
            done.append((conv_id, n, said.hexdigest(), learned_chars, learned.hexdigest(), chars))

        def flush():
            rows = list(zip(*done)) or [[] for _ in columns]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], columns)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv_id, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{unescaped(role)}\n{unescaped(content)}\n".encode())
                for span in loss:
                    learned = unescaped(text[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield flush()
        if state is not None:
            close()
            yield flush()

    return ordered.mapInArrow(
        task, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
