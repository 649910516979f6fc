"""Reads whose plan runs on another number of cores than it was made on."""

import pytest
from pyspark.sql import functions as F

from rowferry.sources import read_delimited, read_lenient, record_lines
from rowferry.sources.records import _ends, file_layout, fixed_lines
from tests.conftest import rows

SPLIT = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")


@pytest.fixture
def cores(spark):
    """Set what splits and their packing follow from."""

    def put(number, cost):
        spark.conf.set(SPLIT[0], number)
        spark.conf.set(SPLIT[1], cost)

    yield put
    for name in SPLIT:
        spark.conf.unset(name)


def lines(folder, name, records, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(end.join(["id,v,w", *records]) + end, encoding="utf-8", newline="")


KINDS = {
    "plain": lambda f, i: f"{f}-{i},x,y",
    "spanning": lambda f, i: f'{f}-{i},"two{chr(10)}lines, {i}",y',
    "spanning at times": lambda f, i: f'{f}-{i},"{"a" + chr(10) + "b" if i % 50 == 3 else "ab"}",y',
    "header again": lambda f, i: "id,v,w" if i == 70 else f"{f}-{i},x,y",
    "blanks": lambda f, i: " " if i == 70 else f"{f}-{i},x,y",
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("built, run", [((2, 1), (40, 1)), ((40, 1), (3, 4000))])
def test_cores_change_after_the_plan(spark, tmp_path, cores, kind, built, run):
    for f in range(3):
        lines(tmp_path, f"{f}.csv", [KINDS[kind](f, i) for i in range(400)])
    cores(*built)
    standard, lenient = read_delimited(spark, str(tmp_path), misfit=True), read_lenient(spark, str(tmp_path))
    bare = read_delimited(spark, str(tmp_path), header=False)
    cores(*run)
    found = standard.collect()
    assert len(found) == 1200 and sum(r.id == "id" for r in found) == (3 if kind == "header again" else 0)
    assert len({r.id for r in found if "-" in (r.id or "")}) == (1197 if kind in ("header again", "blanks") else 1200)
    assert sum(r.misfit for r in found) == (3 if kind == "blanks" else 0)
    if kind == "spanning":
        assert {r.v.split(", ")[0] for r in found} == {"two\nlines"}
        # By lines, each record is two.
        assert lenient.count() == 2400
    elif kind != "spanning at times":
        assert lenient.count() == 1200 and sum(r.id == "id" for r in lenient.collect()) == (3 if kind == "header again" else 0)
    assert bare.count() == 1203


def test_many_headers(spark, tmp_path, cores):
    """Files with one header are scanned, the others cut; the columns come in the order of the files."""
    lines(tmp_path, "1.csv", [f"{i},a,b" for i in range(300)])
    (tmp_path / "0.csv").write_text("w,id\n" + "".join(f"w,{i}\n" for i in range(300, 600)))
    lines(tmp_path, "2.csv", [f'{i},"a{chr(10)}",b' for i in range(600, 900)])
    cores(2, 1)
    df = read_delimited(spark, str(tmp_path))
    cores(40, 1)
    assert df.columns == ["w", "id", "v"]
    assert sorted(int(r.id) for r in df.collect()) == list(range(900))
    assert {(r.w, r.v) for r in df.collect()} == {("w", None), ("b", "a"), ("b", "a\n")}


@pytest.mark.parametrize("quoted", [False, True])
def test_files_with_carriage_returns_alone(spark, tmp_path, cores, quoted):
    """They are split like others; their cells may hold line feeds."""
    cell = '"x\n""\ry"' if quoted else "x"
    lines(tmp_path / "cr", "1.csv", [f"{i},{cell},z" for i in range(2000)], "\r")
    lines(tmp_path / "cr", "2.csv", [f"{i},{cell},z" for i in range(2000, 2100)], "\r\n")
    cores(16, 1)
    df = read_delimited(spark, str(tmp_path / "cr"))
    assert sorted(int(r.id) for r in df.collect()) == list(range(2100))
    assert {r.v for r in df.collect()} == {'x\n"\ry' if quoted else "x"} and {r.w for r in df.collect()} == {"z"}
    if quoted:
        layout = file_layout(spark, str(tmp_path / "cr"), ",", "id,v,w", True)
        assert sorted(len(f) for f in _ends(spark, layout.others).values()) == [1, 1]
        # One part a task.
        assert len(fixed_lines(spark, str(tmp_path / "cr"), layout.others, "\r").inputFiles()) > 8
    else:
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_names_of_files(spark, tmp_path):
    """Signs that paths and patterns treat in a special way."""
    folder = tmp_path / "a b"
    lines(folder, "x[1] %20+é.csv", ["1,a,b"])
    lines(folder, "y {2}.csv", ['2,"a\nb",b'])
    lines(folder, "z#?.csv", [" ", "3,a,b"])
    found = read_delimited(spark, str(folder), misfit=True)
    assert rows(found.where("not misfit").select("id", "v")) == [("1", "a"), ("2", "a\nb"), ("3", "a")]
    assert rows(record_lines(spark, str(folder)).select("value")) == sorted([(" ",), ("1,a,b",), ('2,"a\nb",b',), ("3,a,b",), *[("id,v,w",)] * 3], key=repr)
