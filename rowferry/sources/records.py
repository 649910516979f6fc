"""Delimited files cut into records in parallel, wherever lines and splits end.

Records end at a line feed, at a carriage return or at both, outside of quoted
cells. One scan tells which files are plain: there every line is a record, and
the reader's own lines are used. The lines of the other files are written once
with their place, so that no later job numbers them otherwise, and are joined
where cells run over their ends. What a line's quotes do to the state "inside a
quoted cell" is a function of that state, and such functions compose: first
within a split, then over the splits of a file. Lines of splits that no cell
crosses are records as they are and meet no shuffle; the others are placed by
a window over their split, and only lines of records that span lines are
grouped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.session import settled

# What a line does to the state, as its state after from 0, plus twice that from 1.
CLOSES, SWAPS, KEEPS, OPENS = 0, 1, 2, 3

# Stands for a record end within a line while records are taken apart.
RECORD_END = "\x00\r\x00"

# The signs that a line reader takes for blanks.
BLANKS = "".join(map(chr, range(33)))

# So many bytes of a file tell which sign ends its lines.
TOLD_BYTES = 1 << 16


def _ends_inside(line: Column, sep: str, inside: bool) -> Column:
    """Whether a line that starts in or out of a quoted cell ends inside one.

    A quote opens a cell only at its start, two quotes inside a cell are one, a
    quote anywhere else is text. No repetition of the pattern gives anything
    back, so that a line is walked once.
    """
    # One sign: a class is faster than looking ahead at every sign.
    apart = "".join(f"\\x{{{ord(c):x}}}" for c in sep)
    edge, other = (f"[{apart}\r\n]", f"[^{apart}\r\n]") if len(sep) == 1 else (f"(?:{apart}|[\r\n])", f"(?:(?!{apart})[^\r\n])")
    within = '[^"]*+(?:""[^"]*+)*+'
    cells = f'(?:(?:"{within}"{other}*+|(?!"){other}++|){edge})*+'
    opened = f'{cells}"{within}'
    pattern = f'(?:{within}(?:"{other}*+{edge}{opened})?+)' if inside else opened
    return F.rlike(line, F.lit(f"\\A{pattern}\\z")).cast("int")


def quote_effect(line: Column, sep: str) -> Column:
    effect = _ends_inside(line, sep, False) + 2 * _ends_inside(line, sep, True)
    return F.when(F.contains(line, F.lit('"')), effect).otherwise(F.lit(KEEPS))


def _files(path: str | Sequence[str]) -> str | list[str]:
    return path if isinstance(path, str) else list(path)


def literal_path(path: str) -> str:
    """A path whose signs of a pattern stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def place() -> list[Column]:
    """Columns that order lines within one run of a plan; another run may number them otherwise."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")]


@dataclass(frozen=True)
class Layout:
    """What one scan tells of files whose lines end at LF, CR or both.

    In a plain file every line that is not empty is a record, the first one is
    ``head``, and there are no lines of blanks alone. Nothing here depends on
    how the files are split.
    """

    head: str | None  # the first line of the first plain file, a header if there are any
    first: str | None  # the first plain file
    others: tuple[str, ...]  # files that are not plain
    spanning: bool  # whether a cell of any of them runs over a line end


def file_layout(spark: SparkSession, path: str | Sequence[str], sep: str, head: str | None, header: bool) -> Layout:
    """Which files are plain: where ``header`` is asked, only files that begin with ``head`` are."""
    value, line = F.col("value"), F.col("line")
    lines = spark.read.text(_files(path)).select("value", *place())
    spans = F.when(F.contains(value, F.lit('"')), _ends_inside(value, sep, False)).otherwise(0)
    blank = (F.btrim(value, F.lit(BLANKS)) == "").cast("int")
    facts = lines.groupBy("file").agg(
        F.max(spans).alias("spans"),
        F.max(F.when(F.length(value) > 0, blank).otherwise(0)).alias("blank"),
        F.min(line).alias("first"),
        F.min(F.when(F.length(value) > 0, line)).alias("filled"),
        F.min(F.when(value == F.lit(head), line)).alias("head"),
    )
    plain = (F.col("spans") == 0) & (F.col("blank") == 0) & (F.col("first") == F.col("filled"))
    if header:
        plain &= F.col("first").eqNullSafe(F.col("head"))
    plain = F.coalesce(plain, F.lit(False))
    # Paths only of files that need the longer way.
    found = facts.where(F.col("filled").isNotNull()).agg(F.min(F.when(plain, F.col("file"))).alias("first"), F.collect_list(F.when(~plain, F.col("file"))).alias("others"), F.max("spans").alias("spans")).head()
    return Layout(head if found.first is not None else None, found.first, tuple(sorted(found.others)), bool(found.spans))


def _ends(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """The files by the sign that ends most of their lines, told by their first bytes.

    Only the number of tasks depends on it: records are the same either way.
    """

    def told(file: str) -> str:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            some = bytes(stream.readNBytes(TOLD_BYTES))
        finally:
            stream.close()
        return "\n" if some.count(b"\n") >= some.count(b"\r") else "\r"

    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for file, end in zip(files, pool.map(told, files)):
            groups.setdefault(end, []).append(file)
    return groups


def fixed_lines(spark: SparkSession, path: str | Sequence[str], files: Sequence[str], end: str | None = None, **more: Column) -> DataFrame:
    """Lines of the given files with their place and more columns, written once: the place stays whatever runs later."""
    read = spark.read if end is None else spark.read.option("lineSep", end)
    lines = read.text(_files(path)).where(F.col("_metadata.file_path").isin(list(files)))
    return settled(lines.select("value", *place(), *(c.alias(n) for n, c in more.items())), "lines")


def _with_states(rows: DataFrame, keys: Sequence[str], order: str, incoming: Column, before: str, after: str) -> DataFrame:
    """Add the state before and after each row, running through the rows of each key."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("effect").isin(CLOSES, OPENS)
    swaps = rows.withColumn("swaps", F.sum((F.col("effect") == SWAPS).cast("int")).over(so_far))
    # After a line that fixes the state, only the swaps since then count.
    at_fixed = F.last(F.when(fixed, F.struct((F.col("effect") == OPENS).cast("int").alias("state"), "swaps")), ignorenulls=True).over(earlier)
    told = swaps.withColumns({"at_fixed": at_fixed, "swaps_before": F.coalesce(F.lag("swaps").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))})
    since = F.col("swaps_before") - F.coalesce(F.col("at_fixed.swaps"), F.lit(0))
    state = told.withColumn(before, (F.coalesce(F.col("at_fixed.state"), incoming) + since) % 2)
    ends = (
        F.when(F.col("effect") == CLOSES, F.lit(0))
        .when(F.col("effect") == OPENS, F.lit(1))
        .when(F.col("effect") == SWAPS, 1 - F.col(before))
        .otherwise(F.col(before))
    )
    return state.withColumn(after, ends).drop("swaps", "at_fixed", "swaps_before")


@dataclass(frozen=True)
class Records:
    """Records with their place, and the first record of each file."""

    rows: DataFrame  # record, file, line (of the first line), piece (within the line)
    heads: DataFrame  # file, line, piece, record of the first record that is not empty


def cut_records(spark: SparkSession, path: str | Sequence[str], sep: str, files: Sequence[str], spanning: bool = True) -> Records:
    """Every record of the given files, empty ones included; a last cell that never closes runs to the end of its file.

    ``spanning`` tells whether a cell of any of them may run over a line end.
    """
    effect = quote_effect(F.col("value"), sep)
    parts = [_cut(fixed_lines(spark, path, group, end, effect=effect), end, spanning) for end, group in sorted(_ends(spark, files).items())]
    return Records(reduce(DataFrame.unionByName, [p.rows for p in parts]), reduce(DataFrame.unionByName, [p.heads for p in parts]))


def _cut(lines: DataFrame, end: str, spanning: bool) -> Records:
    filled = F.length(F.btrim("value", F.lit("\r\n"))) > 0
    fixed = F.col("effect").isin(CLOSES, OPENS)
    splits = lines.groupBy("file", "start").agg(
        F.max((F.col("effect") % 2 == 1).cast("int")).alias("opens"),
        F.min(F.when(filled, F.col("line"))).alias("line"),
        # The last line that fixes the state, and the state.
        F.max(F.when(fixed, 2 * F.col("line") + (F.col("effect") == OPENS).cast("int"))).alias("fixed"),
    )
    splits = settled(splits, "splits")
    first = splits.groupBy("file").agg(F.min("line").alias("line")).where("line IS NOT NULL")
    heads = settled(lines.join(first, ["file", "line"]).select("file", "line", "value", "effect"), "heads")
    rows = _pieces(_joined_lines(lines, splits, end) if spanning else lines.select("value", "file", "line"), end)
    simple = not spanning or heads.where("effect % 2 = 1").isEmpty()
    first_records = _pieces(heads.select("value", "file", "line"), end) if simple else rows.join(heads.select("file", "line"), ["file", "line"])
    found = first_records.where("record <> ''").groupBy("file", "line").agg(F.min_by(F.struct("piece", "record"), "piece").alias("first"))
    found = found.select("file", "line", "first.piece", "first.record")
    return Records(rows, found if simple else settled(found, "heads"))


def _pieces(lines: DataFrame, end: str) -> DataFrame:
    """Records within whole lines: outside of quotes the other line end is one too."""
    value, other = F.col("value"), "\r" if end == "\n" else "\n"
    # Of CR and LF together, one has ended the line and the other stands at its edge.
    if end == "\n":
        clean = F.when(F.endswith(value, F.lit(other)), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    else:
        clean = F.when(F.startswith(value, F.lit(other)), F.substring(value, F.lit(2), F.length(value))).otherwise(value)
    parts = F.transform(
        F.split(clean, '"', -1),
        lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(other), F.lit(RECORD_END))).otherwise(part),
    )
    pieces = F.when(F.contains(clean, F.lit(other)), F.split(F.array_join(parts, '"'), RECORD_END, -1)).otherwise(F.array(clean))
    return lines.select("file", "line", F.posexplode(pieces).alias("piece", "record"))


def _joined_lines(lines: DataFrame, splits: DataFrame, end: str) -> DataFrame:
    """Lines, those of one record that spans lines joined."""
    # Splits as functions of the state: fixed by their last line that fixes it, and the swaps since.
    swaps = lines.where(F.col("effect") == SWAPS).select("file", "start", "line").join(splits.select("file", "start", "fixed"), ["file", "start"])
    since = swaps.where(F.col("fixed").isNull() | (2 * F.col("line") > F.col("fixed"))).groupBy("file", "start").agg((F.count("*") % 2).alias("swaps"))
    splits = splits.join(since, ["file", "start"], "left").withColumn("swaps", F.coalesce("swaps", F.lit(0)))
    state = (F.col("fixed") % 2 + F.col("swaps")) % 2
    effect = F.when(F.col("fixed").isNull(), F.when(F.col("swaps") == 1, SWAPS).otherwise(KEEPS)).otherwise(F.when(state == 1, OPENS).otherwise(CLOSES))
    splits = splits.select("file", "start", "opens", effect.alias("effect"))
    states = _with_states(splits, ["file"], "start", F.lit(0), "incoming", "outgoing")
    crossed = settled(states.where("opens = 1 OR incoming = 1").select("file", "start", "incoming"), "crossed")

    alone = lines.join(crossed.select("file", "start"), ["file", "start"], "left_anti").select("value", "file", "line")
    placed = _with_states(lines.join(crossed, ["file", "start"]), ["file", "start"], "line", F.col("incoming"), "before", "after")
    begins = F.when(F.col("before") == 0, F.col("line"))
    so_far = Window.partitionBy("file", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("first", F.last(begins, ignorenulls=True).over(so_far))
    single = placed.where("before = 0 AND after = 0").select("value", "file", "line")
    spanning = placed.where("before = 1 OR after = 1").select("file", "start", "line", "value", "first")
    # Lines at the head of a split may belong to a record begun in an earlier one.
    begun = spanning.groupBy("file", "start").agg(F.max("first").alias("latest"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.select("file", "start", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    owned = spanning.join(carried, ["file", "start"]).withColumn("owner", F.coalesce("first", "carried"))
    gathered = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("parts"))
    joined = gathered.select(F.array_join("parts.value", end).alias("value"), "file", F.col("owner").alias("line"))
    return alone.unionByName(single).unionByName(joined)
