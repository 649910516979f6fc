"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance to be toxic is a logistic
function of its words and their beginnings; the document's is the noisy-or of its sentences, one
less the chance that none is. Only documents are labelled: the words' weights
are fitted to their labels through the noisy-or, after which each sentence's
own chance says where the offence is.

The fit takes a bounded sample of labelled rows (SAMPLE, TRAIN_BYTES); scoring
takes all sentences of all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.text import LOWER, WORD_BYTE, chunks, hash_spans, mix, words
from rowferry.llm.units import release_encoders

#: Labelled documents that are learned from, chosen by a hash of their id, and the longest text among them.
SAMPLE = 6000
TRAIN_BYTES = 32 << 10
#: Lengths in bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (3, 4, 5)
#: Sampled documents that must hold a feature, and the features that get a weight: those that tell labels apart best.
MIN_DOCUMENTS = 6
FEATURES = 4000
STEPS = 200
RATE = 0.1
#: Pull of every weight towards zero; weights that cannot pay for it stay at zero.
LASSO = 3e-5
START_BIAS = -6.0
OFFENSIVE = 0.5

NOT_STOP = np.ones(256, bool)
NOT_STOP[[ord(c) for c in ".!?\n"]] = False


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Features and the sentence of each, then start, end and row of each sentence with words.

    A word's features are the hashes of itself and of its first bytes.
    """
    starts, ends, row = words(data, offsets, NOT_STOP)
    word_starts, word_ends, _ = words(data, offsets, WORD_BYTE)
    owner = np.searchsorted(starts, word_starts, "right") - 1
    held = np.unique(owner)
    owner = np.searchsorted(held, owner)
    hashes, owners = [hash_spans(data, word_starts, word_ends, LOWER)], [owner]
    for size in BEGINNINGS:
        long = word_ends - word_starts > size
        hashes.append(mix(hash_spans(data, word_starts[long], word_starts[long] + size, LOWER) + np.uint64(size)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners), starts[held], ends[held], row[held]


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights, and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def log_clean(self, hashes: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        """Log chance of each sentence not to be toxic; a repeated word counts once a sentence."""
        total = np.full(count, self.bias)
        if len(self.words) and len(hashes):
            low = np.zeros(1 << 20, bool)
            low[self.words & np.uint64((1 << 20) - 1)] = True
            maybe = np.flatnonzero(low[hashes & np.uint64((1 << 20) - 1)])
            spot = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            hit = self.words[spot] == hashes[maybe]
            pairs = np.unique(sentence[maybe[hit]] * len(self.words) + spot[hit])
            total += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=count)
        return -np.logaddexp(0, total)


def _parts(texts: pa.Array):
    """Chunks of the texts: first row, and what ``sentences`` says of each."""
    first = 0
    for part, data, offsets in chunks(pa.RecordBatch.from_arrays([texts], ["text"])):
        yield first, part.num_rows, sentences(data, offsets)
        first += part.num_rows


def _telling_features(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features whose documents differ most in their labels from the rest, in order."""
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    for first, rows, (features, sentence, _, _, row) in _parts(texts):
        known, number = np.unique(features, return_inverse=True)
        pairs = np.unique(number * rows + row[sentence])
        count = np.bincount(pairs // rows, minlength=len(known)).astype(float)
        bad = np.bincount(pairs // rows, weights=toxic[first + pairs % rows], minlength=len(known))
        keys = np.concatenate([held[0], known])
        merged, where = np.unique(keys, return_inverse=True)
        held = (merged, *(np.bincount(where, weights=np.concatenate(c), minlength=len(merged)) for c in ((held[1], count), (held[2], bad))))
    features, count, bad = held
    share = toxic.mean()
    contrast = np.abs(bad - count * share) / np.sqrt(np.maximum(count, 1) * share * (1 - share))
    contrast[count < MIN_DOCUMENTS] = -1
    chosen = np.sort(np.argsort(-contrast, kind="stable")[:FEATURES])
    return features[chosen[contrast[chosen] > 0]]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Weights that make the noisy-or of sentences likeliest under the documents' labels (Adam, with an absolute penalty).

    Without rows of both labels nothing can be told apart: no word has a
    weight, and the bias makes every sentence clean or toxic.
    """
    toxic = labels == 1
    if not len(labels) or toxic.all() or not toxic.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if len(labels) and toxic.all() else -40.0)
    chosen = _telling_features(texts, toxic)
    if not len(chosen):
        return Model(chosen, np.zeros(0), -40.0)
    size, rows, count = len(chosen), len(labels), 0
    pairs_of, rows_of = [], []
    for first, _, (features, own, starts, _, own_row) in _parts(texts):
        spot = np.minimum(np.searchsorted(chosen, features), size - 1)
        hit = chosen[spot] == features
        pairs_of.append(np.unique((own[hit] + count) * size + spot[hit]))
        rows_of.append(own_row + first)
        count += len(starts)
    pairs, row = np.concatenate(pairs_of), np.concatenate(rows_of)
    sentence, word = pairs // size, pairs % size
    weights, bias = np.zeros(size), START_BIAS
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(sentence, weights=weights[word], minlength=count)
        clean = np.bincount(row, weights=-np.logaddexp(0, logit), minlength=rows)
        chance = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        # Of the loss by a sentence's logit: its chance, for a toxic document times minus the odds of clean.
        clean = np.minimum(clean, -1e-9)
        odds = np.exp(clean) / -np.expm1(clean)
        slope = chance * np.where(toxic, -odds, 1.0)[row] / rows
        gradient = np.append(np.bincount(word, weights=slope[sentence], minlength=size), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        scale = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        move = scale * first / (1 - 0.9**step)
        weights -= move[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale[:-1] * LASSO, 0)
        bias -= move[-1]
    return Model(chosen, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable=None, sample: int = SAMPLE, id_column: str = "doc_id") -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of rows where ``usable`` holds.

    At most ``sample`` labelled ids, chosen by a hash of the id, and texts of
    at most TRAIN_BYTES are taken to the driver. Null labels and ids are left
    out; of several labels of one id the highest counts; of several texts of
    one id each counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_column).alias("doc_id"), "text").where(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample)
    held = rows.select("text", "toxic").toArrow().combine_chunks()
    texts = held["text"].combine_chunks() if held.num_rows else pa.array([], pa.string())
    return fit(texts if isinstance(texts, pa.Array) else texts.chunk(0), held["toxic"].to_numpy().astype(np.int64))


def score_texts(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns, score, and offending: the likely toxic sentences (start, end in code points, score).

    A text without words, empty or null, has score 0 and no sentences. Rows are
    scored each for itself; extra columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        release_encoders()
        model = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                hashes, sentence, starts, ends, row = sentences(data, offsets)
                clean = model.log_clean(hashes, sentence, len(starts))
                score = -np.expm1(np.bincount(row, weights=clean, minlength=part.num_rows))
                bad = np.flatnonzero(-np.expm1(clean) >= OFFENSIVE)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[offsets[row[bad]]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(points[starts[bad]] - base), pa.array(points[ends[bad]] - base), pa.array(-np.expm1(clean[bad]))], ["start", "end", "score"]
                )
                cuts = np.searchsorted(row[bad], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.clip(score, 0.0, 1.0)), pa.ListArray.from_arrays(pa.array(cuts), spans)],
                    [*columns, "score", "offending"],
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(task, f"{kinds}, score double, offending array<struct<start:long,end:long,score:double>>")
