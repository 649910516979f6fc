"""Stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and returns the rows that go on, with the
columns of documents; the last returns the token ids. Columns beside the text
travel as one struct, so their names meet none of the operators'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.bpe import decode_ids, encode_texts
from rowferry.llm.decontaminate import find_hits
from rowferry.llm.jaccard import similar_documents
from rowferry.llm.queries import BYTE_RANKS, TOXIC, learned, table
from rowferry.llm.secret_scan import find_secrets, mask
from rowferry.llm.tokens import pattern, vocabulary
from rowferry.llm.toxicity import score_texts, train
from rowferry.session import settled as settle

CARRIED = ("row", "text")


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def _unpacked(rows: DataFrame, columns: list[str], text="text", **changed) -> DataFrame:
    kept = {c: F.col(f"row.{c}") for c in columns if c != "text"} | {"text": F.col(text)} | changed
    return rows.select(*(kept[c].alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model is learned from labelled rows of these documents."""
    model = train(docs, table(spark, sf_dir, "labels"), learned())
    return _unpacked(score_texts(_packed(docs), model, CARRIED).where(F.col("score") < TOXIC), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without words all stay.

    Rows are told apart by id: those of one id, or without one, go only if each of them would.
    """
    found = similar_documents(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
    gone = settle(found.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("NOT stays").select("doc_id"), "gone")
    d, g = docs.alias("d"), gone.alias("g")
    return d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    hits = find_hits(_packed(docs), table(spark, sf_dir, "benchmark"), CARRIED)
    return _unpacked(hits.where("n_hit = 0"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a marker and n_chars counted anew where that happened."""
    masked = find_secrets(_packed(docs), columns=CARRIED).withColumn("masked", mask())
    changed = {}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked")).otherwise(F.col("row.n_chars")).cast(kind)
    return _unpacked(masked.withColumn("clean", F.coalesce("masked", "text")), docs.columns, "clean", **changed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of the whole text, and whether they decode to it."""
    ranks = vocabulary(BYTE_RANKS)
    encoded = encode_texts(docs.select("doc_id", "text"), ranks, pattern(), ("doc_id", "text"))
    decoded = decode_ids(encoded, ranks, ("doc_id", "text", "ids"))
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: A trained model scores the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
