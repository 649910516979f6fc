"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.bpe import round_trips
from rowferry.llm.chat import conversation_digests, format_conversations
from rowferry.llm.decontaminate import find_hits
from rowferry.llm.jaccard import similar_documents
from rowferry.llm.language import predict_languages, settled_profiles
from rowferry.llm.neighbours import nearest_vectors
from rowferry.llm.pages import main_texts
from rowferry.llm.periodic import periodic_runs
from rowferry.llm.quality import judge
from rowferry.llm.secret_scan import BASE_RULES, find_secrets
from rowferry.llm.tokens import pattern, read_tokens, token_digests, vocabulary, write_tokens
from rowferry.llm.toxicity import score_texts, train
from rowferry.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, code_vectors
from rowferry.session import scratch_path

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Score from which a document counts as toxic.
TOXIC = 0.5


def _remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def learned():
    """Rows whose labels may be learned."""
    return _remainder("doc_id", 5) != 0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("hits.item_id", lambda x: x.cast("string")))
    return hits.withColumn("items", F.filter(items, lambda x: x.isNotNull())).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, gram)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

def op2_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(read_tokens(spark, path))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(of, base),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)))
    learned = docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return predict_languages(docs, settled_profiles(learned), ("doc_id", "held_out"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)))
    model = train(docs, table(spark, sf_dir, "labels"), learned())
    return score_texts(docs, model, ("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), pattern())


#: A conversation of control strings that the query adds to the table.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    hard = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    added = turns.select("conv_id", "turn", "role", "text").unionByName(hard.withColumn("turn", F.col("turn").cast("long")))
    return conversation_digests(format_conversations(added))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
safe AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>') AS t,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>'), chr(10), '\n') AS r
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + length(r) + 13) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _planted(rows, counts: np.ndarray) -> np.ndarray:
    """In one of ten rows, by the crc32 of the id, the words from a place on repeat with a period."""
    crc = rows.column("crc").fill_null(1).to_numpy()
    rest, n = crc // 10, np.maximum(counts, 1)
    begin = rest % n
    period = np.where(crc % 10 == 0, 1 + (counts - begin) // (3 + rest % 8), n)
    begin = np.where(crc % 10 == 0, begin, 0)
    first = np.cumsum(counts) - counts
    base = np.repeat(first + begin, counts)
    beyond = np.arange(counts.sum()) - base
    return base + np.where(beyond < 0, beyond, beyond % np.repeat(period, counts))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("crc", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = periodic_runs(docs, ("doc_id", "crc"), reorder=_planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The rounds one after the other, over one row a component; components are whole numbers throughout."""
    steps = [f"""
kept AS (
  SELECT vec_id, label, embedding AS e, len(embedding) // {PARTS} AS m FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
comps AS MATERIALIZED (
  SELECT vec_id, CAST((i - 1) // m AS INT) AS part, CAST((i - 1) % m AS INT) AS pos, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, e, m, unnest(range(1, len(e) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT k, part, pos, x AS c
  FROM comps JOIN (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {ENTRIES} + k) // {ENTRIES} AS d, CAST(min(d * {ENTRIES} + k) % {ENTRIES} AS INT) AS k
  FROM (SELECT vec_id, part, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comps JOIN b{r} USING (part, pos) GROUP BY vec_id, part, k)
  GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT k, part, pos, coalesce(n, c) AS c
  FROM b{r} LEFT JOIN (
    SELECT part, k, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS n
    FROM (SELECT part, k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comps JOIN a{r} USING (vec_id, part) GROUP BY part, k, pos))
  USING (part, k, pos))""")
    steps.append(f"""
coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, k, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_similar_documents": op2_similar_documents,
    "op3_token_files": op3_token_files,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_nearest_vectors": op11_nearest_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op2_similar_documents": OP2_SQL,
    "op9_chat_format": OP9_SQL,
    "op13_vector_codes": _op13_sql(),
}
