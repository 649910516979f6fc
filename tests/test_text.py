import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowferry.functions import clean_header, parse_datetime, safe_name, split_quoted, unquote
from rowferry.functions.text import cell_count, char_count
from rowferry.plans import decode_delimiter

BLANKS = "".join(map(chr, range(0x21)))


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "v string").select(expression(F.col("v"))).head()[0]


def cells_by_hand(line, sep):
    """The lenient rules, character by character."""
    cells, cell, quoted = [], "", False
    for char in line:
        if char == '"':
            quoted = not quoted
            cell += char if sep == "\t" else ""
        elif char == sep and not quoted:
            cells.append(cell)
            cell = ""
        else:
            cell += char
    out = []
    for cell in [*cells, cell]:
        cell = cell.strip(BLANKS)
        enclosed = len(cell) >= 2 and cell[0] == cell[-1] == '"'
        braced = len(cell) >= 5 and cell.startswith('"{') and cell.endswith('}"') and "}" not in cell[2:-2]
        out.append(cell[1:-1] if enclosed and not braced else cell)
    return out


@pytest.mark.parametrize(
    "sep, line, expected",
    [
        (",", 'a,"b,c",d', ["a", "b,c", "d"]),
        (",", ' a / "b,c" ,  d ', ["a / b,c", "d"]),
        (",", ",,", ["", "", ""]),
        (",", 'say ""hi""', ["say hi"]),
        ("\t", "a\t\tb", ["a", "", "b"]),
        ("\t", '"a\tb"\t"{G-1}"\tx "y" z', ["a\tb", '"{G-1}"', 'x "y" z']),
        (" ", "a  b", ["a", "", "b"]),
        ("|", "a|b\x01c|d", ["a", "b\x01c", "d"]),
        ("\t", 'a\x01s"q"\tb', ['a\x01s"q"', "b"]),
        (".", "a.b", ["a", "b"]),
    ],
)
def test_split_quoted(spark, sep, line, expected):
    assert one(spark, line, lambda c: split_quoted(c, sep)) == expected == cells_by_hand(line, sep)
    assert one(spark, line, lambda c: cell_count(c, sep)) == len(expected)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lines=st.lists(st.text(alphabet='ab{}" ,\t|\x01se', min_size=1, max_size=30), min_size=20, max_size=40),
    sep=st.sampled_from([",", "\t", "|", " "]),
)
def test_split_quoted_as_by_hand(spark, lines, sep):
    df = spark.createDataFrame([(line,) for line in lines], "v string")
    counted = cell_count(F.col("v"), sep).alias("n")
    for row in df.select("v", split_quoted(F.col("v"), sep).alias("cells"), counted).collect():
        assert row.cells == cells_by_hand(row.v, sep), (sep, row.v)
        assert row.n == len(row.cells)


def test_unquote(spark):
    for text, expected in [('"a"', "a"), ('"{G}"', '"{G}"'), ('""', ""), ('"', '"'), ('a"b', 'a"b'), ('"a"b"', 'a"b'), ('"x\ny"', "x\ny")]:
        assert one(spark, text, unquote) == expected


def test_header_and_names(spark):
    assert one(spark, '"a""', clean_header) == 'a"'
    assert one(spark, "my table.v-1/x", safe_name) == "my_table_v-1_x"


def test_char_count(spark):
    assert one(spark, "a§b§c", lambda c: char_count(c, "§")) == 2
    assert one(spark, "", lambda c: char_count(c, ",")) == 0


def test_parse_datetime(spark):
    parse = lambda c: parse_datetime(c, ["yyyy-MM-dd HH:mm", "dd/MM/yyyy"]).cast("string")
    assert one(spark, "2020-01-02 03:04", parse) == "2020-01-02 03:04:00"
    assert one(spark, "05/01/2021", parse) == "2021-01-05 00:00:00"
    assert one(spark, "soon", parse) is None
    assert one(spark, "1969-12-31 23:59", parse) == "1969-12-31 23:59:00"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, "2024-03-10 02:30", parse) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_delimiters():
    spelled = {r"\n": "\n", r"\t": "\t", r"\r": "\r", r"\b": "\b", r"\f": "\f", r"\'": "'", r"\"": '"', r"\\": "\\", "tab": "\t"}
    for text, char in spelled.items():
        assert decode_delimiter(text) == char
    assert decode_delimiter(",") == "," and decode_delimiter("||") == "|" and decode_delimiter(" ") == " "
    assert decode_delimiter("||", multi_char=True) == "||"
    for wrong in (None, "", "  "):
        with pytest.raises(ValueError):
            decode_delimiter(wrong)
