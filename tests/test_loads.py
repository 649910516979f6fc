import pytest
from pyspark.errors import StreamingQueryException

from rowferry.operators.quality import TooManyBadRows
from rowferry.operators.sets import append_union
from rowferry.plans import LoadSpec
from rowferry.sinks import append_rows, create_table, load_file, load_outcome
from rowferry.sources import catalog_inventory, catalog_tables, jdbc_options, preview_table, scan_table
from rowferry.session import scratch_path
from rowferry.streaming import load as stream_module, loaded_rows, progress_rows, stream_load
from tests.conftest import rows

TEXT = "id,name,day\n1,ann,2020-01-01\n2,bob,\n"
TYPES = {"id": "Int32", "name": "String", "day": "Date"}


def write(tmp_path, text=TEXT, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_create(spark):
    assert create_table(spark, "made", {"a": "Int32", "": "Date", "b c": " "})
    assert not create_table(spark, "made", {"other": "String"})
    assert spark.table("made").dtypes == [("a", "int"), ("b c", "string")]
    for name, types in ((" ", TYPES), ("x", {}), ("x", {" ": "Int32"})):
        with pytest.raises(ValueError):
            create_table(spark, name, types)
    assert create_table(spark, "2020_sales", {"a": "Int32"})
    assert append_rows(spark.sql("select 3 as a, 'skipped' as z"), "2020_sales") == 1
    assert rows(spark.table("`2020_sales`")) == [(3,)]


def test_load(spark, tmp_path):
    path = write(tmp_path)
    done = load_file(spark, path, LoadSpec("people", create=True, column_types=TYPES))
    assert rows(done.as_frame(spark)) == [(2, True, "Upload successful")]
    assert spark.table("people").dtypes == [("id", "int"), ("name", "string"), ("day", "date")]
    # An existing table keeps its types; only the chosen columns are loaded.
    assert load_file(spark, path, LoadSpec("people", columns=("id",))).lines == 2
    assert rows(spark.table("people").selectExpr("id", "name", "string(day)"))[:2] == [(1, "ann", "2020-01-01"), (1, None, None)]
    assert spark.table("people").count() == 4


def test_load_without_types_keeps_file_order(spark, tmp_path):
    load_file(spark, write(tmp_path, "z;a\n1;2\n"), LoadSpec("untyped", create=True, delimiter=";"))
    assert spark.table("untyped").dtypes == [("z", "string"), ("a", "string")]


def test_load_without_header(spark, tmp_path):
    spec = LoadSpec("bare", create=True, has_header=False, column_types={"Column1": "Int32", "Column2": "String"})
    load_file(spark, write(tmp_path, "1,x\n2,y\n"), spec)
    assert rows(spark.table("bare")) == [(1, "x"), (2, "y")]


def test_bad_rows(spark, tmp_path):
    some = "id\n" + "".join(f"{i}\n" for i in range(50)) + "x\n" * 10
    assert load_file(spark, write(tmp_path, some), LoadSpec("tolerant", create=True, column_types={"id": "Int32"})).rejected == 10
    assert spark.table("tolerant").count() == 50
    kept = str(tmp_path / "kept")
    spec = LoadSpec("tolerant", column_types={"id": "Int32"})
    assert load_file(spark, write(tmp_path, "id\n1\nx\n", "one.csv"), spec, rejects=kept).rejected == 1
    assert rows(spark.read.parquet(kept)) == [("x", "id")]
    with pytest.raises(TooManyBadRows):
        load_file(spark, write(tmp_path, some + "x\n"), LoadSpec("tolerant", column_types={"id": "Int32"}))
    assert spark.table("tolerant").count() == 51


def test_failure_is_reported(spark, tmp_path):
    failed = load_outcome(spark, write(tmp_path), LoadSpec("no_such_table"))
    assert (failed.lines, failed.success) == (0, False) and failed.message.startswith("Error: ")


def test_tables(spark):
    spark.range(150).write.saveAsTable("numbers")
    assert "numbers" in catalog_tables(spark)
    assert preview_table(scan_table(spark, "numbers")).count() == 100
    assert {r.table_name: r.row_count for r in catalog_inventory(spark).collect()}["numbers"] == 150
    with pytest.raises(ValueError):
        scan_table(spark, "")


def test_append_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([("q", 2), ("r", 3)], "unknown string, id int")
    assert rows(append_union(a, b)) == [(1, "x"), (2, None), (3, None)]


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "t", user="u")
    assert plain == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "user": "u"}
    cut = jdbc_options("jdbc:x", "t", partition_column="id", bounds=(1, 9), partitions=4)
    assert (cut["lowerBound"], cut["upperBound"], cut["numPartitions"]) == ("1", "9", "4")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")


def test_scratch_is_shared(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.conf.get("spark.checkpoint.dir") in scratch_path(spark, "x")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    places = (str(folder), TYPES, str(tmp_path / "out"), str(tmp_path / "state"))
    write(folder, name="1.csv")
    write(folder, "id,name,day\n3,cy,2021-05-05\nx,bad,\n", "2.csv")
    stream_load(spark, *places, files_per_batch=1)
    assert [r.rows_so_far for r in progress_rows(spark, places[3]).orderBy("batch").collect()][-1] == 3
    # Nothing new, nothing loaded; then only the new file.
    stream_load(spark, *places)
    assert loaded_rows(spark, places[2]).count() == 3
    kept = str(tmp_path / "bad")
    stream_load(spark, places[0], TYPES, str(tmp_path / "again"), str(tmp_path / "again-state"), rejects=kept)
    assert rows(loaded_rows(spark, kept)) == [("x", "bad", None, "id")]
    write(folder, "id,name,day\n4,di,\n", "3.csv")
    stream_load(spark, *places)
    assert [r.rows_read for r in progress_rows(spark, places[3]).orderBy("batch").collect()][-1] == 1
    assert rows(loaded_rows(spark, places[2]).select("id")) == [(1,), (2,), (3,), (4,)]


def test_stream_goes_by_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, 'name,id\n"a\nb",1\n', "1.csv")
    write(folder, "id,score,name\n2,7,x\n", "2.csv")
    stream_load(spark, str(folder), {"id": "Int32", "name": "String"}, str(tmp_path / "out"), str(tmp_path / "s"))
    assert rows(loaded_rows(spark, str(tmp_path / "out"))) == [(1, "a\nb"), (2, "x")]
    with pytest.raises(StreamingQueryException, match="no column missing"):
        stream_load(spark, str(folder), {"missing": "Int32"}, str(tmp_path / "o2"), str(tmp_path / "s2"))
    bare = tmp_path / "bare"
    bare.mkdir()
    write(bare, "5,e\n", "1.csv")
    stream_load(spark, str(bare), {"id": "Int32", "name": "String"}, str(tmp_path / "o3"), str(tmp_path / "s3"), header=False)
    assert rows(loaded_rows(spark, str(tmp_path / "o3"))) == [(5, "e")]


def test_stream_budget(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "id\n" + "x\n" * 1000 + "1\n")
    with pytest.raises(StreamingQueryException, match="1000 of 1001"):
        stream_load(spark, str(folder), {"id": "Int32"}, str(tmp_path / "out"), str(tmp_path / "s"))
    assert not (tmp_path / "out").exists()


def test_ragged_rows_are_bad_rows(spark, tmp_path):
    half = "".join(f"{i},x,y\n" for i in range(500)) + "".join(f"{i}\n" for i in range(500))
    spec = LoadSpec("ragged_half", create=True, column_types={"a": "Int32", "b": "String"})
    with pytest.raises(TooManyBadRows, match="1000 of 1000"):
        load_file(spark, write(tmp_path, "a,b\n" + half), spec)
    kept = str(tmp_path / "kept")
    few = "a,b\n" + "".join(f"{i},x\n" for i in range(20)) + "7\n8,x,y\n"
    assert load_file(spark, write(tmp_path, few, "few.csv"), spec, rejects=kept).rejected == 2
    assert {r.bad_columns for r in spark.read.parquet(kept).collect()} == {"(width)"}


def test_absent_declared_column(spark, tmp_path):
    spec = LoadSpec("absent", create=True, column_types=TYPES | {"more": "String"})
    with pytest.raises(ValueError, match="no column more"):
        load_file(spark, write(tmp_path), spec)


def test_a_load_reads_its_text_once(spark, tmp_path):
    """Nothing of a refused load is seen, and nothing of it is left; other tables than plain Parquet get an insert."""
    bad = write(tmp_path, "id,name\n" + "x,y\n" * 50 + "1,a\n", "bad.csv")
    good = write(tmp_path, "id,name\n1,a\n2,b\n", "good.csv")
    for kind in ("USING parquet", "USING orc", "USING parquet PARTITIONED BY (id)"):
        place = tmp_path / kind.split()[1] / str(len(kind))
        spark.sql("DROP TABLE IF EXISTS staged_load")
        spark.sql(f"CREATE TABLE staged_load (name STRING, id INT) {kind} LOCATION '{place}'")
        for _ in range(2):
            done = load_file(spark, good, LoadSpec("staged_load"))
            assert (done.lines, done.rejected) == (2, 0)
            with pytest.raises(TooManyBadRows, match="50 of 51"):
                load_file(spark, bad, LoadSpec("staged_load"))
        assert rows(spark.table("staged_load").select("id", "name")) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
        assert not [p for p in place.rglob("*") if p.name.startswith("_load")]
    spark.sql("DROP TABLE staged_load")


def test_bytes_are_those_of_the_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = 'id,unused,name\n1,"é, é","a ""b"""\n\n2,x,\n'
    write(folder, text, "1.csv")
    stream_load(spark, str(folder), {"id": "Int32", "name": "String"}, str(tmp_path / "out"), str(tmp_path / "s"))
    assert [r.bytes_so_far for r in progress_rows(spark, str(tmp_path / "s")).collect()] == [len(text.encode())]


def test_a_batch_that_fails_midway(spark, tmp_path, monkeypatch):
    """Readers see what the ledger names: nothing of a failed attempt, and its rerun once."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, name="1.csv")
    places = (str(folder), TYPES, str(tmp_path / "out"), str(tmp_path / "state"))
    stream_load(spark, *places)
    write(folder, "id,name,day\n3,cy,\n", "2.csv")
    enter, calls = stream_module.enter, []

    def fails(*args):
        calls.append(args)
        if len(calls) == 1:
            raise OSError("lost")
        enter(*args)
        if len(calls) == 2:
            raise OSError("lost after the entry")

    monkeypatch.setattr(stream_module, "enter", fails)
    with pytest.raises(StreamingQueryException, match="lost"):
        stream_load(spark, *places)
    assert rows(loaded_rows(spark, places[2]).select("id")) == [(1,), (2,)]
    before = loaded_rows(spark, places[2])
    with pytest.raises(StreamingQueryException, match="after the entry"):
        stream_load(spark, *places)
    assert rows(before.select("id")) == [(1,), (2,)]
    assert rows(loaded_rows(spark, places[2]).select("id")) == [(1,), (2,), (3,)]
    stream_load(spark, *places)
    assert rows(loaded_rows(spark, places[2]).select("id")) == [(1,), (2,), (3,)]
    assert [r.rows_so_far for r in progress_rows(spark, places[3]).orderBy("batch").collect()] == [2, 3]
