"""Text helpers, all built from JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.plans.spec import quote_name

# Characters removed by trimming, the quote that is stripped
# around a cell (kept around {...}), characters not allowed in a file name,
# and the count of delimiters and quotes above which a line is complex.
BLANKS = "".join(chr(code) for code in range(0x21))
ENCLOSING_QUOTES = r'(?s)\A"(?!\{[^}]+\}"\z)(.*)"\z'
UNSAFE_NAME_CHARS = r"[^a-zA-Z0-9\-_]"
COMPLEX_LINE_COUNT = 10

# From a quote to the next one, or to the end.
QUOTED_PART = r'"[^"]*("|\z)'

AROUND_BLANKS = r"[\x00-\x20]*"


def trim_cell(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def trim_cells(df: DataFrame) -> DataFrame:
    return df.select(*[trim_cell(F.col(quote_name(c))).alias(c) for c in df.columns])


def unquote(cell: Column) -> Column:
    """Remove one pair of enclosing quotes, except around ``{...}``."""
    return F.regexp_replace(cell, ENCLOSING_QUOTES, "$1")


def clean_header(cell: Column) -> Column:
    return F.regexp_replace(cell, r'\A"|"\z', "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, UNSAFE_NAME_CHARS, "_")


# Fixed value: how a row of one column without a value is spelled, as its line would be empty.
ONLY_NULL = "\\N"
LIKE_NULL = r"\A\\+N\z"


def spell_null(text: Column) -> Column:
    """Text of the only column of a file: NULL is spelled, texts spelled like it get a backslash more."""
    return F.when(text.isNull(), F.lit(ONLY_NULL)).when(text.rlike(LIKE_NULL), F.concat(F.lit("\\"), text)).otherwise(text)


def read_null(text: Column) -> Column:
    """The reverse of ``spell_null``."""
    return F.when(text.rlike(LIKE_NULL), F.nullif(F.substring(text, 2, 1 << 30), F.lit("N"))).otherwise(text)


def iso_text(ts: Column) -> Column:
    """Zone-less timestamp as ISO text with all its microseconds."""
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))


def parse_datetime(text: Column, formats: Sequence[str]) -> Column:
    """The first format that fits wins; NULL when none does.

    Texts are read as UTC and kept without a zone, so the session zone and its
    clock changes do not matter.
    """
    tries = [F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{f} xx")) for f in formats]
    seconds = (F.unix_micros(F.coalesce(*tries)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast(T.TimestampNTZType()) + F.make_dt_interval(secs=seconds)


def char_count(text: Column, char: str) -> Column:
    without = F.replace(text, F.lit(char), F.lit(""))
    return ((F.octet_length(text) - F.octet_length(without)) / len(char.encode())).cast("int")


def is_complex_line(line: Column, sep: str) -> Column:
    """A line with many delimiters and many quotes."""
    return (char_count(line, sep) > COMPLEX_LINE_COUNT) & (char_count(line, '"') > COMPLEX_LINE_COUNT)


def cell_count(line: Column, sep: str) -> Column:
    """How many cells ``split_quoted`` finds, without cutting them out."""
    outside = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, QUOTED_PART, "")).otherwise(line)
    return char_count(outside, sep) + 1


def split_quoted(line: Column, sep: str, keep_quotes: bool | None = None) -> Column:
    """Cells of one line: a quote switches quoting on or off, separators count
    only outside quotes, cells are trimmed.

    Quotes vanish, so a quote can mark the cell borders without clashing with
    the data. With ``keep_quotes``, the rule for tab-separated lines, they stay
    while scanning and cells lose only an enclosing pair; there an escaped
    control character marks the borders.
    """
    border = f'{AROUND_BLANKS}"{AROUND_BLANKS}'
    unquoted = F.split(trim_cell(F.replace(line, F.lit(sep), F.lit('"'))), border)

    def outside(mark: str, source: Column):
        return F.transform(
            F.split(source, '"', -1),
            lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(sep), F.lit(mark))).otherwise(part),
        )

    if sep == "\t" if keep_quotes is None else keep_quotes:
        escaped = F.replace(line, F.lit("\x01"), F.lit("\x01e"))
        joined = F.array_join(outside("\x01s", escaped), '"')
        quoted = F.transform(
            F.split(joined, "\x01s", -1),
            lambda cell: unquote(trim_cell(F.replace(cell, F.lit("\x01e"), F.lit("\x01")))),
        )
    else:
        joined = trim_cell(F.array_join(outside('"', line), ""))
        quoted = F.split(joined, border)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(unquoted)
