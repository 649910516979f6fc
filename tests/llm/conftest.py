import pytest
from pyspark.sql import functions as F

LONG = "the cat sat on a mat and " * 40_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "one TWO three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "é è ß 日本語 \U0001f642 x"),
    (7, LONG),
    (None, "a row without an id"),
    (8, "equal"),
    (8, "equal"),
    (9, "equal"),
    (10, "short"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as operators name theirs."""
    rows = [(i, t, None if i == 4 else "en", "src" if i != 5 else None, len(t or "")) for i, t in TEXTS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit("extra") for c in ("score", "ids", "spans", "hits", "class", "key", "row", "size", "component", "held_out")}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
