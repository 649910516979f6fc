import random
from itertools import combinations

import pytest

from rowferry.operators.infer import infer_types, suggested_types
from rowferry.operators import profile
from rowferry.operators.profile import (
    bad_width_lines,
    candidate_keys,
    candidate_keys_composite,
    column_inventory,
    detect_delimiter,
    estimate_size,
    table_inventory,
    table_row_count,
    validate_width,
)
from rowferry.operators.quality import ErrorBudget, TooManyBadRows, check_budget, error_budget, good_rows, reject_rows, validate_types
from rowferry.sources import record_lines, text_lines
from tests.conftest import rows

UUIDS = ("0b5c11d4-9f3e-4c58-8a77-c0ffee123456", "00000000-0000-0000-0000-000000000000", "FFFFFFFF-FFFF-FFFF-FFFF-FFFFFFFFFFFF")

SAMPLES = [
    ("Int32", ("17", "-3", "2147483647")),
    ("Int64", ("2147483648", "1", "2")),
    ("Float64", ("8.5", "0.125", "-3.0")),
    ("Float64", ("9223372036854775808", "1", "2")),
    ("Float64", ("1", "2.5", "1e3")),
    ("String", ("perch", "eel", "pike")),
    ("Date", ("2011-03-09", "1999-12-31", "2020-02-29")),
    ("DateTime", ("2019-06-01T07:45:00", "1999-12-31T23:59:59", "2020-02-29T00:00:00")),
    ("Bool", ("true", "false", "TRUE")),
    ("Bool", ("yes", "1", "no")),
    ("Int32", ("1", "0", "1")),
    ("UUID", UUIDS),
    ("String", ("17", "eel", "9")),
    ("String", ("8.5", "pike", "true")),
    ("String", ("2011-03-09", "spring", "1999-12-31")),
    ("String", ("2011-03-09", "2011-03-09T10:00:00", None)),
    ("Int32", ("17", None, "")),
    ("String", (None, None, None)),
    ("String", ("", "", "")),
    ("Float64", ("NaN", "Infinity", " 1 ")),
    ("String", ("nan", "1", "2")),
]


def test_detected_types(spark):
    names = [f"c{i}" for i in range(len(SAMPLES))]
    df = spark.createDataFrame(list(zip(*[values for _, values in SAMPLES])), ", ".join(f"{n} string" for n in names))
    assert suggested_types(df) == {n: kind for n, (kind, _) in zip(names, SAMPLES)}


def test_suggested_types(spark):
    header = "tank string, species string, litres string, ph string, filled string, fed_at string, heated string, tag string"
    tanks = [
        ("41", "guppy", "180", "7.25", "2011-03-09", "2019-06-01T07:45:00", "yes", UUIDS[0]),
        ("42", "tetra", "96", "6.5", "2016-10-30", "2019-06-01T08:05:30", "no", UUIDS[1]),
        ("43", "loach", "240", "7", "2018-01-12", "2019-05-31T23:10:59", "yes", UUIDS[2]),
    ]
    kinds = ["Int32", "String", "Int32", "Float64", "Date", "DateTime", "Bool", "UUID"]
    df = spark.createDataFrame(tanks, header)
    assert list(suggested_types(df).values()) == kinds
    assert set(suggested_types(df.limit(0)).values()) == {"String"}
    assert infer_types(df).columns == ["column_name", "type_name"]


def write_lines(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_width(spark, tmp_path):
    def check(text):
        lines = text_lines(spark, write_lines(tmp_path, f"w{hash(text)}", text))
        return tuple(validate_width(lines, ",").head())

    assert check("a,b\n1,2\n") == (2, 2, 2, 2, True)
    assert check("a,b,c\n1,2\n") == (2, 3, 2, 3, False)
    assert check('a,b\n"1,2",3\n') == (2, 2, 2, 2, True)
    assert check("") == (0, None, None, None, False)
    spanning = record_lines(spark, write_lines(tmp_path, "span", 'a,b\n"x\ny",2\n'))
    assert tuple(validate_width(spanning, ",").head()) == (2, 2, 2, 2, True)
    lines = text_lines(spark, write_lines(tmp_path, "bad", "a,b,c\n1,2\nx,y,z\n"))
    assert rows(bad_width_lines(lines, ",", 3)) == [("1,2", 2)]


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_delimiter(spark, tmp_path, sep):
    text = "".join(sep.join([str(i), "a;b" if sep != ";" and i == 3 else "ab", "c"]) + "\n" for i in range(9))
    lines = text_lines(spark, write_lines(tmp_path, f"d{ord(sep)}", text))
    assert tuple(detect_delimiter(lines).head()) == (sep, 3, 9)


def test_no_delimiter(spark, tmp_path):
    assert detect_delimiter(text_lines(spark, write_lines(tmp_path, "none", "a\nb\n"))).collect() == []


def test_inventories(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, None, -0.0), (3, "a", None)], "id bigint, v string, x double")
    expected = [("id", "bigint", 0, 3), ("v", "string", 1, 1), ("x", "double", 1, 1)]
    assert rows(column_inventory(df)) == expected
    assert rows(column_inventory(df, approximate=True)) == expected
    assert rows(table_inventory({"t": df, "none": df.limit(0)})) == [("none", 0), ("t", 3)]
    with pytest.raises(ValueError):
        table_row_count(spark, " ")


def test_keys(spark):
    wide = spark.range(5000).selectExpr("id", "id % 4999 as nearly", "if(id = 4321, null, id) as gap", "id % 7 as few")
    found = {r.column_name: (r.row_count, r.null_count, r.is_key) for r in candidate_keys(wide).collect()}
    assert found == {"id": (5000, 0, True), "nearly": (5000, 0, False), "gap": (5000, 1, False), "few": (5000, 0, False)}
    assert not any(r.is_key for r in candidate_keys(wide.limit(0)).collect())


def test_size(spark):
    df = spark.createDataFrame([(1, "ab"), (22, "c")], "id int, v string")
    assert tuple(estimate_size(df).head()) == (2, 200, len("1,ab\n22,c\n"))


TYPES = {"id": "Int32", "day": "Date", "note": "String"}


def text_rows(spark, bad, total):
    return spark.range(total).selectExpr(
        f"if(id < {bad}, 'x', string(id)) as id", "if(id = 0, 'soon', '2020-01-01') as day", "'n' as note"
    )


def test_bad_rows(spark):
    df = text_rows(spark, 2, 5)
    assert good_rows(df, TYPES).count() == 3
    assert rows(reject_rows(df, TYPES)) == [("x", "2020-01-01", "n", "id"), ("x", "soon", "n", "id,day")]
    assert rows(validate_types(df, TYPES)) == [("day", "Date", 5, 1), ("id", "Int32", 5, 2), ("note", "String", 5, 0)]


@pytest.mark.parametrize(
    "bad, total, fits",
    [(10, 20, True), (11, 20, False), (11, 1100, True), (11, 1099, False), (0, 0, True), (50, 5000, True), (51, 5000, False)],
)
def test_budget_needs_both_limits_exceeded(spark, bad, total, fits):
    df = text_rows(spark, bad, total)
    types = {"id": "Int32"}
    assert tuple(error_budget(df, types).head()) == (total, bad, fits)
    if fits:
        assert check_budget(df, types) == (total, bad)
    else:
        with pytest.raises(TooManyBadRows):
            check_budget(df, types)
    assert check_budget(df, types, ErrorBudget(10_000, 0)) == (total, bad)


def brute_keys(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for places in combinations(range(len(names)), size):
            values = [tuple(r[k] for k in places) for r in rows]
            if rows and not any(set(key) <= set(places) for key in found) and None not in {v for t in values for v in t} and len(set(values)) == len(rows):
                found.append(places)
    return sorted((",".join(names[k] for k in places), len(places), len(rows)) for places in found)


@pytest.mark.parametrize("seed, values", [(1, 40), (2, 12), (3, 6)])
def test_composite_keys_against_all_sets(spark, seed, values):
    rng = random.Random(seed)
    names = ["a", "key_columns", "k", "value.x", "e", "0"]
    rows = [(k // 15, k % 15, *(rng.randrange(values) for _ in range(3)), rng.choice([None, 1, 2])) for k in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names))
    for most in (1, 2, 3):
        assert sorted(map(tuple, candidate_keys_composite(df, most).collect())) == brute_keys(rows, names, most)


def test_composite_keys_of_odd_tables(spark):
    df = spark.range(200).selectExpr("id", "id % 20 as m", "cast(id as string) as s", "repeat('x', 300) || (id div 20) as long", "null as n")
    assert sorted(map(tuple, candidate_keys_composite(df).collect())) == [("id", 1, 200), ("m,long", 2, 200), ("s", 1, 200)]
    assert candidate_keys_composite(df.where("false")).collect() == []
    assert candidate_keys_composite(df.union(df)).collect() == []
    # A third of all rows in one value, unique only together.
    hot = spark.range(900).selectExpr("if(id % 3 = 0, -1, id) as h", "id div 3 as g", "id % 3 as r")
    assert sorted(map(tuple, candidate_keys_composite(hot).collect())) == [("g,r", 2, 900), ("h,g", 2, 900)]


@pytest.mark.parametrize("hashes, probe", [(1 << 62, 20), (11, 20)])
def test_composite_keys_of_parts_and_of_equal_hashes(spark, monkeypatch, hashes, probe):
    """A part of the entries only tells sets that are no keys; different values of one hash are no repeat."""
    set_hash = profile._set_hash
    monkeypatch.setattr(profile, "_set_hash", lambda columns: set_hash(columns) % hashes)
    monkeypatch.setattr(profile, "PROBE_ROWS", probe)
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "t", "f"]
    rows = [(k // 15, k % 15, rng.randrange(40), k + (k == 299) * -1, f"x{k % 60}", (k % 100) * 0.5) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b int, c long, d long, t string, f double")
    assert sorted(map(tuple, candidate_keys_composite(df).collect())) == brute_keys(rows, names, 2)
