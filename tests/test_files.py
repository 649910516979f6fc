import csv
import random
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import rowferry.sources.records as record_files
from rowferry.sinks import export_delimited, export_format, export_name, export_quoted
from rowferry.sources import preview_file, read_delimited, read_lenient, record_lines, sample_file, text_lines
from tests.conftest import rows

PEOPLE = [("1", "John Doe", "john@example.com"), ("2", "Jane Roe", "jane@example.com")]
ODD = [
    ("1", "Likes apples, oranges", "x"),
    ("2", 'Said, "Hello!"', None),
    ("3", "Loves reading\nand hiking", ""),
    ("4", "á é í ó ú ñ 漢字 & ₹ € £ ¥", "  ends  "),
    ("5", "tab\tpipe|backslash\\", '"'),
]


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("sep", [",", "\t", "|", ";", " "])
def test_read(spark, tmp_path, sep):
    lines = [sep.join(["id", "name", "email"])] + [sep.join(r[:1] + (r[1].replace(" ", "_"),) + r[2:]) for r in PEOPLE]
    path = write(tmp_path / "p.txt", "\n".join(lines) + "\n")
    df = read_delimited(spark, path, sep)
    assert df.columns == ["id", "name", "email"]
    assert rows(df)[0] == ("1", "John_Doe", "john@example.com")


@pytest.mark.parametrize("quoted", [False, True])
@pytest.mark.parametrize("sep", [",", r"\t", "|"])
def test_round_trip(spark, tmp_path, sep, quoted):
    df = spark.createDataFrame(ODD, "id string, text string, more string")
    out = str(tmp_path / "nested" / "folder")
    written = (export_quoted if quoted else export_delimited)(df, out, sep)
    assert written == len(ODD)
    # With quotes around everything NULL and empty text look the same.
    expected = df.na.fill("") if quoted else df
    assert rows(read_delimited(spark, out, sep)) == rows(expected)


def test_quotes_around_everything(spark, tmp_path):
    export_quoted(spark.createDataFrame([("1", "a")], "id string, v string"), str(tmp_path / "q"))
    assert {r.value for r in spark.read.text(str(tmp_path / "q")).collect()} == {'"id","v"', '"1","a"'}


def test_columns_names_and_missing_file(spark, tmp_path):
    path = write(tmp_path / "p.csv", "id,name,email\n1,John,j@x\n2,Jane,k@x\n")
    assert rows(read_delimited(spark, path, columns=["email", "id"])) == [("j@x", "1"), ("k@x", "2")]
    plain = read_delimited(spark, path, header=False, rename={"Column2": "who"})
    assert plain.columns == ["Column1", "who", "Column3"] and plain.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_delimited(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError):
        read_delimited(spark, path, sep="")


def test_multi_character_delimiter(spark, tmp_path):
    path = write(tmp_path / "m.txt", "a||b\n1||2|3\n")
    assert rows(read_delimited(spark, path, "||", multi_char=True)) == [("1", "2|3")]


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "e.csv", "")
    assert preview_file(spark, path).collect() == []
    assert read_lenient(spark, path).collect() == []


def test_preview(spark, tmp_path):
    body = "".join(f'{i}, "v, {i}" \n' for i in range(500))
    path = write(tmp_path / "p.csv", '"id",name\n' + body)
    shown = preview_file(spark, path)
    assert shown.columns == ["id", "name"]
    assert [tuple(r) for r in shown.collect()] == [(str(i), f"v, {i}") for i in range(99)]
    bare = preview_file(spark, path, header=False)
    assert bare.columns == ["Column1", "Column2"] and bare.count() == 100
    only = preview_file(spark, write(tmp_path / "h.csv", "a,b\n"))
    assert [tuple(r) for r in only.collect()] == [("(No data)", "(No data)")]


def test_lenient_keeps_lines_equal_to_the_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n\n1,2\na,b\n")
    write(folder / "2.csv", "a,b\n3\n")
    assert rows(read_lenient(spark, str(folder))) == sorted([("1", "2"), ("3", None), ("a", "b")], key=repr)


def test_sample(spark, tmp_path):
    path = write(tmp_path / "s.csv", "id,v\n" + "".join(f" {i} , x \n" for i in range(3000)))
    got = sample_file(spark, path).collect()
    assert [tuple(r) for r in got] == [(str(i), "x") for i in range(999)]
    assert sample_file(spark, path, header=False).count() == 1000
    loose = "\t".join(f'"c{i}"' for i in range(12))
    odd = sample_file(spark, write(tmp_path / "odd.tsv", (loose + "\n") * 300), "tab", header=False)
    assert odd.count() == 100 and odd.head().Column12 == "c11"


@pytest.mark.parametrize("name, reader", [("CSVWithNames", "csv"), (" ", "csv"), ("NoSuch", "csv"), ("JSONEachRow", "json"), ("parquet", "parquet"), ("ORC", "orc")])
def test_formats(spark, tmp_path, name, reader):
    df = spark.createDataFrame([("1", "a,b"), ("2", None)], "id string, v string")
    out = str(tmp_path / "out")
    assert export_format(df, out, name) == 2
    back = read_delimited(spark, out) if reader == "csv" else spark.read.format(reader).schema(df.schema).load(out)
    assert rows(back) == rows(df)


def test_export_name():
    assert export_name("db.my table") == "db_my_table.csv"


@pytest.fixture
def spanning(tmp_path):
    """Random files whose cells run over line ends, and their records."""
    choose, records = random.Random(7), []
    for f in range(3):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["id", "two\nlines", "c"])
            for i in range(300):
                cells = [f"{f}-{i}", *("".join(choose.choices('ab ,"\n\r|é', k=choose.choice([0, 1, 5, 80, 900]))) for _ in "xy")]
                writer.writerow(cells)
                records.append(tuple(c or None for c in cells))
    return str(tmp_path), sorted(records, key=repr)


@pytest.mark.parametrize("split", [None, "10000", "700"])
def test_records_do_not_depend_on_splits(spark, spanning, split):
    path, records = spanning
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_delimited(spark, path)
        assert got.columns == ["id", "two\nlines", "c"]
        assert sorted((tuple(c or None for c in r) for r in got.collect()), key=repr) == records
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def quote_state(line, sep, inside):
    """Whether a line ends inside a quoted cell, sign by sign."""
    at_start, k = not inside, 0
    while k < len(line):
        c = line[k]
        if inside:
            if c == '"' and line[k + 1 : k + 2] == '"':
                k += 1
            elif c == '"':
                inside = False
        elif c == '"' and at_start:
            inside = True
        at_start = not inside and c in (sep, "\r")
        k += 1
    return inside


def test_quote_effects(spark):
    choose = random.Random(3)
    lines = ["".join(choose.choices('a,"\r', k=choose.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    for r in df.select("v", record_files.quote_effect(F.col("v"), ",").alias("e")).collect():
        assert r.e == quote_state(r.v, ",", False) + 2 * quote_state(r.v, ",", True), repr(r.v)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cells=st.lists(
        st.tuples(*[st.none() | st.text(alphabet='ab ,"\n\r\t|\\é;\x01', max_size=12)] * 2), min_size=5, max_size=40
    ),
    sep=st.sampled_from([",", r"\t", "|"]),
)
def test_any_text_survives(spark, tmp_path, cells, sep):
    df = spark.createDataFrame([(str(i), *pair) for i, pair in enumerate(cells)], "id string, a string, b string")
    out = str(tmp_path / uuid.uuid4().hex)
    export_delimited(df, out, sep)
    assert rows(read_delimited(spark, out, sep)) == rows(df)


def test_stray_quotes_are_text(spark, tmp_path):
    path = write(tmp_path / "stray.csv", 'a,b\n5" pipe,x\n7" pipe,y\nz,"two\nlines"\n')
    assert rows(read_delimited(spark, path)) == [('5" pipe', "x"), ('7" pipe', "y"), ("z", "two\nlines")]
    assert read_delimited(spark, write(tmp_path / "long.csv", 'a,b\n5" pipe,x\n' + "y,z\n" * 400)).count() == 401


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_line_ends(spark, tmp_path, end):
    path = write(tmp_path / "e.csv", end.join(["", "", "a,b", "", '1,"x\r\ny"', " , ", "", "2,z"]) + end)
    assert rows(read_delimited(spark, path)) == sorted([("1", "x\r\ny"), (" ", " "), ("2", "z")], key=repr)


def test_first_files_without_rows(spark, tmp_path):
    for name, text in (("0", ""), ("1", "\n" * 300), ("2", "a,b\n1,2\n")):
        write(tmp_path / f"{name}.csv", text)
    folder = str(tmp_path)
    for read in (read_delimited, read_lenient, preview_file, sample_file):
        assert rows(read(spark, folder)) == [("1", "2")]
    assert read_delimited(spark, folder, header=False).columns == ["Column1", "Column2"]


def test_headers_in_another_order(spark, tmp_path):
    write(tmp_path / "1.csv", "id,name\n1,x\n")
    write(tmp_path / "2.csv", "name,id\ny,2\n")
    write(tmp_path / "3.csv", "id\n3\n")
    assert rows(read_delimited(spark, str(tmp_path))) == sorted([("1", "x"), ("2", "y"), ("3", None)], key=repr)


def test_misfits(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,misfit\n1,2\n1\n1,2,3\n")
    got = read_delimited(spark, path, misfit=True)
    assert got.columns == ["a", "misfit", "misfit_"]
    assert sorted(r.misfit_ for r in got.collect()) == [False, True, True]


def test_rows_of_nothing_survive(spark, tmp_path):
    one = spark.createDataFrame([("x",), (None,), ("",), ("\\N",), ("\\\\N",), (" ",)], "v string")
    two = spark.createDataFrame([("x", None), (None, None)], "a string, b string")
    export_delimited(one, str(tmp_path / "one"))
    export_delimited(two, str(tmp_path / "two"), "tab")
    assert rows(read_delimited(spark, str(tmp_path / "one"))) == rows(one)
    assert rows(read_delimited(spark, str(tmp_path / "two"), "tab")) == rows(two)


def test_record_lines(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'a,b\n"x\ny",1\n\n')
    assert [r.value for r in record_lines(spark, path).orderBy("position").collect()] == ["a,b", '"x\ny",1']


def test_line_positions(spark, tmp_path):
    write(tmp_path / "b.csv", "3\n")
    write(tmp_path / "a.csv", "1\n\n2\n")
    ordered = text_lines(spark, str(tmp_path)).orderBy("position").select("value")
    assert [r.value for r in ordered.collect()] == ["1", "2", "3"]
