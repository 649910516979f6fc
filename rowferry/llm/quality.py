"""Quality rules: base rules a document, then robust multivariate outliers.

The minimum covariance determinant of each language and source is estimated
over the distinct statistics of all its documents that meet the base rules, so
exact copies count once: from several deterministic starts, every step takes
the (n + P + 1) / 2 smallest Mahalanobis distances and computes centre and
covariance of these anew, until the determinants no longer fall; the least one
is kept. A step is two aggregations with partial sums, so a group of any size is
never in one task. Documents far from their group's centre are rejected; small groups are judged
by their language's estimate, small languages by that of all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.text import ASCII_SPACE, NOT_SPACE, chunks, gram_hashes, hash_spans, words
from rowferry.session import settled as settle

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Shares of a group, of which the one next to (n + P + 1) / 2 rows is the estimate's core: it bears the most outliers.
SHARES = [k / 200 for k in range(100, 201)]
#: Documents that a core has at least, where there are so many.
MIN_CORE = 30
#: A group of fewer distinct documents than this is judged by its language's estimate over all
#: sources, a language of fewer by that over all documents.
MIN_GROUP = 60
#: Share of its log determinant by which a trial must fall to go on.
TOLERANCE = 1e-4
#: Squared distance that is rejected, in multiples of the number of statistics
#: (the mean of a normal variable's). Text statistics have longer tails than normal ones.
CUTOFF = 20.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:48] = PUNCTUATION[58:65] = PUNCTUATION[91:97] = PUNCTUATION[123:127] = True

_U64 = np.uint64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_distinct_words", "n_upper", "n_punctuation", "n_lines"]
STATISTICS = ["word_length", "richness", "upper", "punctuation", "line_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _row_keys(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Row in the upper ten bits, 54 bits of the hash below."""
    return row.astype(_U64) << _U64(54) | hashes >> _U64(10)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of at most 1024 rows."""
    rows = len(offsets) - 1
    starts, ends, row = words(data, offsets, NOT_SPACE)
    hashes = hash_spans(data, starts, ends)
    out = {"n_words": np.bincount(row, minlength=rows)}
    out["word_chars"] = _per_row(NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_row(SYMBOLS[data], offsets)
    line_starts, line_ends, line_row = words(data, offsets, np.arange(256) != 10)
    filled = np.concatenate([[0], np.cumsum(~ASCII_SPACE[data])])
    own = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, line_row = line_starts[own], line_ends[own], line_row[own]
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    distinct = np.unique(_row_keys(hash_spans(data, line_starts, line_ends), line_row))
    out["n_dup_lines"] = out["n_lines"] - np.bincount((distinct >> _U64(54)).astype(np.int64), minlength=rows)
    grams = gram_hashes(hashes, 3)
    at = np.flatnonzero(row[: len(grams)] == row[2:]) if len(grams) else np.zeros(0, np.int64)
    keys = _row_keys(grams[at], row[at])
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(hashes) + 3, bool)
    if len(twice):
        low = np.zeros(1 << 16, bool)
        low[twice & _U64(0xFFFF)] = True
        maybe = np.flatnonzero(low[keys & _U64(0xFFFF)])
        spot = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        hit = at[maybe[twice[spot] == keys[maybe]]]
        for k in range(3):
            cover[hit + k] = True
    out["n_repeat_words"] = np.bincount(row[cover[: len(row)]], minlength=rows)
    distinct = np.unique(_row_keys(hashes, row))
    out["n_distinct_words"] = np.bincount((distinct >> _U64(54)).astype(np.int64), minlength=rows)
    out["n_upper"] = _per_row(UPPER[data], offsets)
    out["n_punctuation"] = _per_row(PUNCTUATION[data], offsets)
    return out


def count_texts(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The given columns and the counts of each whole text; a null text has none of anything."""
    names = COUNTS + EXTRA

    def task(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, rows=1000):
                found = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [pa.array(found[c].astype(np.int64)) for c in names], [*columns, *names]
                )

    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return docs.mapInArrow(task, ", ".join(kinds + [f"{c} long" for c in names]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _vector(counts: DataFrame) -> DataFrame:
    """The transformed statistics of documents with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "word_length": F.col("word_chars") / n,
            "richness": F.log(F.greatest(F.col("n_distinct_words"), F.lit(1))) / F.log(n + 1),
            "upper": F.log((F.col("n_upper") + 1) / (F.col("word_chars") + 1)),
            "punctuation": F.log((F.col("n_punctuation") + 1) / (F.col("word_chars") + 1)),
            "line_words": F.log(n / F.greatest(F.col("n_lines"), F.lit(1))),
        }
    )


def chi_square(share: float, p: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * math.sqrt(2 / (9 * p))) ** 3


def consistency(share: float, p: int) -> float:
    """What the covariance of a normal variable's innermost share is to be multiplied by."""
    from statistics import NormalDist

    if share > 0.995:
        return 1.0
    spread = 2 / (9 * (p + 2))
    return share / NormalDist().cdf(((chi_square(share, p) / (p + 2)) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
GROUP = ["lang", "source"]
#: What an estimate is made over: level 0 is a language and source, 1 a language, 2 all documents.
POOL = ["level", *GROUP]
#: An estimate in the making: one of a pool's starts.
TRIAL = [*POOL, "start"]
CENTRE = [f"c{i}" for i in range(P)]
MATRIX = [f"p{i}_{j}" for i, j in _PAIRS]


def _total(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _distance() -> Column:
    centred = [F.col(s) - F.col(f"c{i}") for i, s in enumerate(STATISTICS)]
    return _total([(1 if i == j else 2) * F.col(f"p{i}_{j}") * centred[i] * centred[j] for i, j in _PAIRS])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The left rows with the other columns of the right side; null keys are equal."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, how).select("a.*", *(F.col(f"b.{c}") for c in right.columns if c not in keys))


def _with(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    return _joined(vectors, estimates, POOL).withColumn("d2", _distance())


def _fields(frame: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre, inverse covariance, log determinant and scale of distances from one row of a core's moments a trial."""

    def task(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["core"]
                cov = np.empty((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"m{i}_{j}"] / r["core"] - mean[i] * mean[j]
                # A statistic that hardly varies in the core keeps a least spread.
                cov += np.diag(1e-6 + 1e-9 * np.abs(mean))
                inverse = np.linalg.inv(cov)
                scale = consistency(r["core"] / r["n"], P)
                rows.append([*(r[c] for c in [*TRIAL, "n"]), *mean, *(inverse[i, j] for i, j in _PAIRS), np.linalg.slogdet(cov)[1], scale])
            yield pd.DataFrame(rows, columns=[*TRIAL, "n", *CENTRE, *MATRIX, "logdet", "scale"])

    doubles = ", ".join(f"{c} double" for c in [*CENTRE, *MATRIX, "logdet", "scale"])
    return moments.mapInPandas(task, f"{_fields(moments, [*TRIAL, 'n'])}, {doubles}")


def _step(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates from the cores of the given ones."""
    near = _with(vectors, estimates.select(*TRIAL, *CENTRE, *MATRIX))
    cuts = near.groupBy(*TRIAL).agg(F.percentile_approx("d2", SHARES, 10000).alias("cuts"))
    core = F.greatest((F.col("n") + P + 1) / 2, F.least(F.col("n"), F.lit(MIN_CORE)))
    at = F.least(F.ceil((core / F.col("n") - SHARES[0]) * 200), F.lit(len(SHARES) - 1)).cast("int")
    cut = F.get("cuts", at).alias("cut")
    known = settle(_joined(estimates, cuts, TRIAL).select(*TRIAL, "n", *CENTRE, *MATRIX, cut), "cuts")
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"m{i}_{j}") for i, j in _PAIRS]
    inner = _with(vectors, known).where("d2 <= cut")
    return _estimates(inner.groupBy(*TRIAL).agg(F.first("n").alias("n"), F.count("*").alias("core"), *sums, *products))


def _starts(vectors: DataFrame) -> DataFrame:
    """Three starts about a pool's medians: scaled median deviations alone, and with the correlations of
    hyperbolic tangents or of directions, neither of which far documents can turn at will."""
    medians = vectors.groupBy(*POOL).agg(F.count("*").alias("n"), *(F.percentile_approx(s, 0.5, 10000).alias(f"c{i}") for i, s in enumerate(STATISTICS)))
    medians = settle(medians.where((F.col("n") >= MIN_GROUP) | (F.col("level") == 2)), "medians")
    spread = [F.percentile_approx(F.abs(F.col(s) - F.col(f"c{i}")), 0.5, 10000).alias(f"mad{i}") for i, s in enumerate(STATISTICS)]
    spreads = _joined(vectors, medians, POOL).groupBy(*POOL).agg(*spread)
    spreads = spreads.withColumns({f"mad{i}": F.sqrt(F.pow(1.4826 * F.col(f"mad{i}"), 2) + 1e-6) for i in range(P)})
    known = settle(_joined(medians, spreads, POOL), "spreads")
    z = _joined(vectors, known, POOL).withColumns({f"z{i}": (F.col(s) - F.col(f"c{i}")) / F.col(f"mad{i}") for i, s in enumerate(STATISTICS)})
    z = z.withColumn("zz", _total([F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]) + 1e-12)
    tanh = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS]
    turn = [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"u{i}_{j}") for i, j in _PAIRS]
    sums = _joined(z.groupBy(*POOL).agg(*tanh, *turn), known, POOL)

    def task(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                mad = np.array([r[f"mad{i}"] for i in range(P)])
                for start, name in enumerate(["", "t", "u"]):
                    shape = np.eye(P)
                    if name:
                        for i, j in _PAIRS:
                            shape[i, j] = shape[j, i] = r[f"{name}{i}_{j}"] / r["n"]
                        own = np.sqrt(np.diag(shape)) + 1e-12
                        shape = shape / np.outer(own, own) + 1e-3 * np.eye(P)
                    inverse = np.linalg.inv(shape * np.outer(mad, mad))
                    rows.append([*(r[c] for c in POOL), start, r["n"], *(r[c] for c in CENTRE), *(inverse[i, j] for i, j in _PAIRS)])
            yield pd.DataFrame(rows, columns=[*TRIAL, "n", *CENTRE, *MATRIX])

    return sums.mapInPandas(task, f"{_fields(sums, POOL)}, start int, n long, " + ", ".join(f"{c} double" for c in [*CENTRE, *MATRIX]))


def _semi(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left_semi")


def _pools(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors of every pool that is needed, and the pool (as level, of_lang, of_source) that judges each group."""
    sizes = settle(vectors.groupBy(*GROUP).agg(F.count("*").alias("n")), "sizes")
    small = sizes.where(F.col("n") < MIN_GROUP).select("lang").distinct()
    own = vectors.select(F.lit(0).alias("level"), *GROUP, *STATISTICS)
    nothing = {c: F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in GROUP}
    languages = _semi(vectors, small).select("lang", *STATISTICS).distinct()
    languages = settle(languages.select(F.lit(1).alias("level"), "lang", nothing["source"], *STATISTICS), "languages")
    spoken = settle(languages.groupBy("lang").agg(F.count("*").alias("n_lang")), "sizes")
    rare = spoken.where(F.col("n_lang") < MIN_GROUP)
    pools = own.unionByName(languages)
    if not rare.isEmpty():
        everything = vectors.select(*STATISTICS).distinct()
        pools = pools.unionByName(everything.select(F.lit(2).alias("level"), nothing["lang"], nothing["source"], *STATISTICS))
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(2)
    judges = _joined(sizes, spoken, ["lang"], "left").select(*GROUP, level.alias("level"))
    of = [F.when(F.col("level") < 2, F.col("lang")).alias("of_lang"), F.when(F.col("level") < 1, F.col("source")).alias("of_source")]
    return settle(pools, "pools"), settle(judges.select(*GROUP, "level", *of), "judges")


def robust_estimates(vectors: DataFrame, pooled: bool = False) -> DataFrame:
    """Per group the estimate of least determinant that its starts lead to, and a scale for distances.

    Each start of each group goes on until its own determinant no longer falls, whatever the others do.

    Every distinct vector of statistics counts once, so copies of a text have no more weight than the text.
    Groups under MIN_GROUP have the estimate of their language or of all documents if ``pooled``, else none.
    """
    vectors = settle(vectors.select(*GROUP, *STATISTICS).distinct(), "vectors")
    if pooled:
        vectors, judges = _pools(vectors)
    else:
        vectors = vectors.withColumn("level", F.lit(0))
    falling = settle(_step(vectors, settle(_starts(vectors), "estimates")), "estimates")
    tried = falling
    while not falling.isEmpty():
        before = falling.select(*TRIAL, F.col("logdet").alias("before"))
        now = settle(_joined(_step(vectors, falling), before, TRIAL), "estimates")
        tried = tried.unionByName(now.drop("before"))
        falling = now.where(F.col("before") - F.col("logdet") > TOLERANCE * F.greatest(F.lit(1.0), F.abs("before"))).drop("before")
    columns = [*CENTRE, *MATRIX, "logdet", "scale"]
    best = tried.groupBy(*POOL).agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("best"))
    best = best.select(*POOL, *(f"best.{c}" for c in columns))
    if not pooled:
        return settle(best.drop("level"), "estimates")
    best = best.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    return settle(_joined(judges, best, ["level", "of_lang", "of_source"]).select(*GROUP, *columns), "estimates")


def judge(docs: DataFrame, id_column: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """Per row: doc_id, lang, source, the counts, base_failed, distance and kept.

    ``distance`` is the squared robust distance within language and source, in
    units in which a normal variable's is chi-square; null where the
    base rules fail. A group under MIN_GROUP is judged by the estimate of its
    language over all sources or, if that is under it too, of all documents;
    with up to MIN_CORE of these none is far from the others. Null languages and
    sources are groups of their own; rows of one id are judged each for itself.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), "lang", "source", "text")
    counts = settle(count_texts(docs).withColumn("base_failed", base_failed()), "counts")
    vectors = _vector(counts)
    estimates = robust_estimates(vectors.where("NOT base_failed").select(*GROUP, *STATISTICS), pooled=True)
    known = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    judged = _joined(vectors, estimates, GROUP, "left").withColumn("distance", known)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff * P, F.lit(True))
    return judged.select(
        F.col("doc_id").alias(id_column), *GROUP, *COUNTS, *EXTRA, *STATISTICS, "base_failed", "distance", kept.alias("kept")
    )
