import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

import rowferry.operators.joins as joins
from rowferry.operators.limits import OrderKey, first_rows, first_rows_of_files, pinned_sort, rows_to_cut, top_groups
from rowferry.plans import ExportSpec, JoinSpec, compile_export, count_export, export_preview, prepare_export
from rowferry.plans.spec import LoadSpec, quote_name, split_reference
from tests.conftest import rows

USERS = [(1, "ann", "a@x"), (2, "bob", "b@x"), (3, "cy", None), (None, "nobody", None)]
ORDERS = [(10, 1, 5.0), (11, 1, 7.0), (12, 2, 9.0), (13, 9, 1.0), (14, None, 2.0)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "users": spark.createDataFrame(USERS, "id bigint, name string, email string"),
        "orders": spark.createDataFrame(ORDERS, "order_id bigint, user_id bigint, total double"),
    }


ON = "users.id = orders.user_id"


def joined(tables, kind, condition=ON, columns=("name", "orders.order_id"), **extra):
    return rows(compile_export(ExportSpec("users", columns, (JoinSpec("orders", kind, condition, **extra),)), tables))


def test_kinds(tables):
    inner = [("ann", 10), ("ann", 11), ("bob", 12)]
    assert joined(tables, "INNER JOIN") == inner
    left = sorted([*inner, ("cy", None), ("nobody", None)], key=repr)
    assert joined(tables, "LEFT JOIN") == joined(tables, None) == joined(tables, " ") == joined(tables, "left outer join") == left
    right = sorted([*inner, (None, 13), (None, 14)], key=repr)
    assert joined(tables, "RIGHT JOIN") == right
    full = sorted([*left, (None, 13), (None, 14)], key=repr)
    assert joined(tables, "FULL JOIN") == joined(tables, "OUTER JOIN") == joined(tables, "FULL OUTER JOIN") == full
    assert joined(tables, "SEMI JOIN", columns=("name",)) == [("ann",), ("bob",)]
    assert joined(tables, "ANTI JOIN", columns=("name",)) == [("cy",), ("nobody",)]
    assert joined(tables, "ANY JOIN", order_by=("total",)) == [("ann", 10), ("bob", 12)]
    assert joined(tables, "LEFT ANY JOIN", order_by=("total",)) == sorted([("ann", 10), ("bob", 12), ("cy", None), ("nobody", None)], key=repr)
    assert joined(tables, "GLOBAL JOIN") == joined(tables, "JOIN") == inner
    assert joined(tables, "GLOBAL LEFT JOIN") == left
    assert joined(tables, "LEFT SEMI JOIN", columns=("name",)) == joined(tables, "SEMI JOIN", columns=("name",))
    assert len(joined(tables, "CROSS JOIN", None)) == len(joined(tables, "INNER JOIN", " ")) == 20
    assert len(joined(tables, "RIGHT JOIN", "")) == 20


def test_conditions(tables):
    assert joined(tables, "INNER JOIN", "orders.user_id=users.id") == joined(tables, "INNER JOIN")
    assert joined(tables, "INNER JOIN", 'users."id" = orders."user_id"') == joined(tables, "INNER JOIN")
    assert joined(tables, "INNER JOIN", "(users.id = orders.user_id AND orders.total > 6)") == [("ann", 11), ("bob", 12)]
    assert joined(tables, "INNER JOIN", "users.id < orders.user_id AND orders.total < 5.0") == [("ann", 13), ("bob", 13), ("cy", 13)]
    assert joined(tables, "SEMI JOIN", "users.id > orders.user_id", columns=("name",)) == [("bob",), ("cy",)]
    assert joined(tables, "INNER JOIN", None, pairs=(("id", "user_id"),)) == joined(tables, "INNER JOIN")
    two = JoinSpec("orders", "INNER JOIN", "users.id = orders.user_id AND orders.order_id = users.id")
    assert two.equal_pairs("users") == [("users", "id", "user_id"), ("users", "id", "order_id")]


def test_errors(tables):
    with pytest.raises(ValueError, match="SEMI or ANTI"):
        joined(tables, "SEMI JOIN")
    with pytest.raises(ValueError, match="order_by"):
        joined(tables, "ANY JOIN")
    with pytest.raises(ValueError, match="unknown join"):
        joined(tables, "SIDEWAYS JOIN")
    with pytest.raises(ValueError):
        ExportSpec(" ", ("a",))
    with pytest.raises(ValueError):
        ExportSpec("t", (" ", ""))
    with pytest.raises(ValueError):
        LoadSpec("")


def test_products_have_no_bound(tables, monkeypatch):
    pairs, less = joined(tables, "CROSS JOIN", None), joined(tables, "INNER JOIN", "users.id < orders.user_id")
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    assert joined(tables, "CROSS JOIN", None) == pairs and len(pairs) == 20
    assert joined(tables, "INNER JOIN", "users.id < orders.user_id") == less
    assert joined(tables, "GLOBAL JOIN") == joined(tables, "INNER JOIN")


def test_any_joins_on_odd_names(spark):
    known = {
        "a": spark.createDataFrame([(1, "x"), (2, "y")], "`k 1` int, v string"),
        "b": spark.createDataFrame([(1, 9), (1, 8)], "`k 1` int, w int"),
    }
    for kind in ("LEFT ANY JOIN", "ANY LEFT JOIN"):
        spec = ExportSpec("a", ("v", "b.w"), (JoinSpec("b", kind, "a.`k 1` = b.`k 1`", order_by=("w",)),))
        assert rows(compile_export(spec, known)) == [("x", 8), ("y", None)]


def test_a_column_chosen_twice_is_numbered(tables):
    assert compile_export(ExportSpec("users", ("id", "name", "id", "id")), tables).columns == ["users_id", "name", "users_id_2", "users_id_3"]


def test_order_columns_do_not_hide_chosen_ones(spark):
    known = {"t": spark.createDataFrame([(2, "a"), (1, "b")], "order_0 int, v string")}
    out = prepare_export(ExportSpec("t", ("order_0", "v"), order_by=("order_0",)), known)
    assert out.columns == ["order_0", "v"] and [tuple(r) for r in out.collect()] == [(1, "b"), (2, "a")]


def test_specs():
    assert JoinSpec("t", "inner join", "a.x = t.y").is_valid
    assert not JoinSpec("t", "INNER JOIN").is_valid and not JoinSpec(" ", "INNER JOIN", "c").is_valid
    assert not JoinSpec("t", None, "c").is_valid and JoinSpec("t", "LEFT", pairs=(("a", "b"),)).is_valid
    assert JoinSpec("t", "LEFT JOIN", "a.x = t.y") == JoinSpec("t", "LEFT JOIN", "a.x = t.y")
    assert quote_name("a`b") == "`a``b`"
    assert split_reference('t."a.b"', "m") == ("t", "a.b") and split_reference('"a"', "m") == ("m", "a")
    assert ExportSpec("t", ("a",)).separator == "," and ExportSpec("t", ("a",), delimiter=r"\t").separator == "\t"


def test_count(tables):
    spec = ExportSpec("users", ("Users.count(*)",), (JoinSpec("orders", "INNER JOIN", ON),))
    assert rows(compile_export(spec, tables)) == [(3,)]
    limited = ExportSpec("users", ("name",), (JoinSpec("orders", "LEFT JOIN", ON),), limit=1)
    assert rows(count_export(limited, tables)) == [(5,)]


def test_limits(spark, tables):
    spec = ExportSpec("orders", ("order_id",), limit=2, order_by=("total",))
    assert [r[0] for r in compile_export(spec, tables).collect()] == [13, 14]
    assert rows(prepare_export(spec, tables)) == [(13,), (14,)]
    many = {"orders": spark.range(500).withColumnRenamed("id", "order_id")}
    for n in (None, 0, -3):
        assert export_preview(ExportSpec("orders", ("order_id",)), many, n).count() == 100
    assert export_preview(ExportSpec("orders", ("order_id",)), many, 7).count() == 7


def test_large_limits_are_exact(spark, tmp_path):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") * 2)
    for n in (99, 2000):
        assert first_rows(df, n, one_task_rows=0).count() == min(n, 1000)
        kept = rows(first_rows(df, n, [F.col("id").desc()], one_task_rows=0))
        assert kept == sorted([(i, 2 * i) for i in range(1000)[-n:]], key=repr)
    path = str(tmp_path / "files")
    df.write.parquet(path)
    files = spark.read.parquet(path)
    for n in (1, 500, 2000):
        first = first_rows_of_files(files, n)
        assert first.count() == min(n, 1000) == first.distinct().count()
        assert set(rows(first)) <= set(rows(first_rows_of_files(files, n + 300)))
    assert first_rows_of_files(files, 0).count() == 1000


KEYS = [
    [OrderKey("id")],
    [OrderKey("id", descending=True)],
    [OrderKey("hot"), OrderKey("name", descending=True), OrderKey("id")],
    [OrderKey("hot", nulls_last=True), OrderKey("at", descending=True, nulls_last=False), OrderKey("id")],
    [OrderKey("day", descending=True), OrderKey("price"), OrderKey("id", descending=True)],
]


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("from_files", [True, False])
def test_limits_sort_only_rows_up_to_the_cut(spark, tmp_path, keys, from_files):
    df = spark.range(6000).selectExpr(
        "id",
        "if(id % 3 = 0, 5L, if(id % 50 = 7, null, id % 100)) as hot",
        "if(id % 11 = 0, null, concat('é', id % 17)) as name",
        "if(id % 13 = 0, null, timestamp_micros(1700000000000000 + id % 29)) as at",
        "date_add(date'2020-01-01', cast(id % 40 as int)) as day",
        "cast(id % 9 as decimal(10,2)) as price",
    )
    if from_files:
        df.repartition(5).write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    every = [tuple(r) for r in df.orderBy(*(key.sort for key in keys)).collect()]
    for n in (300, 2500, 6000, 9000):
        kept = first_rows(df, n, keys, one_task_rows=0, sampled=1000)
        assert rows(kept) == sorted(every[:n], key=repr)
    held = rows_to_cut(df, 600, keys, sampled=1000).count()
    assert 600 <= held <= 1100


def test_finding_the_cut_reads_only_the_keys(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id", "repeat('x', 50) as wide").write.parquet(str(tmp_path / "t"))
    plans, plain = [], DataFrame.count

    def count(self):
        plans.append(self.groupBy().count()._jdf.queryExecution().executedPlan().toString())
        return plain(self)

    monkeypatch.setattr(DataFrame, "count", count)
    rows_to_cut(spark.read.parquet(str(tmp_path / "t")), 500, [OrderKey("id")], sampled=1000)
    assert len(plans) >= 2 and not any("wide" in plan.split("ReadSchema")[-1] for plan in plans)
    assert "ReadSchema: struct<id:bigint>" in plans[-1]


def test_cut_of_equal_rows_and_empty_tables(spark):
    # All rows have one key; a hash of the other columns cuts among them.
    df = spark.range(5000).selectExpr("1 as k", "id as v")
    kept = first_rows(df, 700, [OrderKey("k")], one_task_rows=0, sampled=1000)
    assert kept.count() == 700 == kept.distinct().count()
    assert rows_to_cut(df, 700, [OrderKey("k")], sampled=1000).count() <= 1200
    # Equal in every column: nothing to cut by, and still exact.
    same = spark.range(3000).selectExpr("cast(null as string) as k", "2 as v")
    assert first_rows(same, 700, [OrderKey("k")], one_task_rows=0, sampled=1000).count() == 700
    assert first_rows(same.where("false"), 700, [OrderKey("k")], one_task_rows=0, sampled=1000).count() == 0


def test_top_and_pinned(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5), ("String", 0), ("d", 2)], "k string, v int")
    assert [tuple(r) for r in top_groups(df, "k", F.sum("v").alias("s"), 3).collect()] == [("c", 5), ("d", 2), ("a", 1)]
    assert [r.k for r in pinned_sort(df, "k", "String").collect()] == ["String", "a", "b", "c", "d"]


@pytest.mark.parametrize("how, bound", [("left", 3), ("right", 3), ("full", 3), ("full", 0), ("full", 40), ("full", 10_000)])
def test_salted_joins_equal_plain_joins(spark, tmp_path, how, bound):
    left = spark.range(300).selectExpr("if(id % 3 = 0, 7, id % 60) as k", "id as a").union(spark.sql("select null, -1L"))
    right = spark.range(200).selectExpr("if(id % 4 = 0, 9, id % 90) as j", "id as b").union(spark.sql("select null, -1L"))
    left.write.parquet(str(tmp_path / "l"))
    for l_df, r_df in ((left, right), (spark.read.parquet(str(tmp_path / "l")), right)):
        plain = l_df.join(r_df, l_df["k"] == r_df["j"], how)
        salted = joins.salted_join(l_df, r_df, [l_df["k"]], [r_df["j"]], how, hot_key_rows=bound)
        assert salted.columns == plain.columns
        assert rows(salted) == rows(plain)


@pytest.mark.parametrize("how", ["left", "right", "full", "left_semi", "left_anti"])
def test_tracked_joins_equal_plain_joins(spark, tmp_path, how):
    spark.range(120).selectExpr("if(id % 3 = 0, 7, id % 30) as k", "id as a").write.parquet(str(tmp_path / "l"))
    spark.range(90).selectExpr("if(id % 4 = 0, 9, id % 40) as j", "id as b").write.parquet(str(tmp_path / "r"))
    tables = {"l": spark.read.parquet(str(tmp_path / "l")), "r": spark.read.parquet(str(tmp_path / "r"))}
    left, right = tables["l"].alias("l"), tables["r"].alias("r")
    on = F.expr("l.k = r.j AND l.a < r.b")
    plain = left.join(right, on, how)
    tracked = joins.tracked_join(left, right, on, [left["k"]], [right["j"]], how, hot_key_rows=5)
    assert tracked.columns == plain.columns
    assert rows(tracked) == rows(plain)
    assert rows(joins.tracked_join(left, right, on, [left["k"]], [right["j"]], how)) == rows(plain)


def test_tracked_joins_keep_table_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 2)
    for name in ("l", "r"):
        spark.range(40).selectExpr("id % 4 as k", "id as v").write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("l", "r")}
    spec = ExportSpec("l", ("k", "v", "r.v"), (JoinSpec("r", "FULL JOIN", "l.k = r.k AND l.v < r.v"),))
    out = prepare_export(spec, tables)
    assert out.columns == ["k", "l_v", "r_v"]
    assert rows(out) == rows(compile_export(spec, tables))


def test_equal_terms():
    def terms(condition):
        return JoinSpec("b", "LEFT JOIN", condition).equal_terms("a")

    assert terms("a.x = b.y") == ([("a", "x", "y")], True)
    assert terms("(b.y = a.x AND a.z > b.w)") == ([("a", "x", "y")], False)
    assert terms("a.x = b.y OR a.z = b.w") == terms("lower(a.x) = lower(b.y)") == terms(" ") == ([], False)


def test_salted_chain_keeps_table_names(spark, tables, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEY_ROWS", 1)
    spec = ExportSpec(
        "orders",
        ("order_id", "users.name", "again.email"),
        (JoinSpec("users", "FULL JOIN", "orders.user_id = users.id"), JoinSpec("again", "LEFT JOIN", "users.id = again.id")),
    )
    all_tables = tables | {"again": tables["users"].union(tables["users"])}
    assert rows(prepare_export(spec, all_tables)) == rows(compile_export(spec, all_tables))


def test_hot_rows_are_spread(spark, tmp_path):
    """Identical rows of a hot key, read from files, get different salts."""
    spark.range(3000).selectExpr("1 as k", "'x' as v").repartition(3).write.parquet(str(tmp_path / "hot"))
    hot = spark.read.parquet(str(tmp_path / "hot"))
    found = joins.hot_keys(hot, [hot["k"]], 100)
    assert rows(found) == [(1, 30)]
    salts = hot.select(F.pmod(F.xxhash64(*joins._row_identity(hot)), F.lit(30)).alias("s")).groupBy("s").count()
    assert salts.count() == 30 and salts.agg(F.max("count")).head()[0] < 300


def test_arrays(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "id int, xs array<int>")
    spec = ExportSpec("t", ("id", "xs_index", "xs_item"), (JoinSpec("t", "ARRAY JOIN", array_column="xs"),))
    assert rows(compile_export(spec, {"t": df})) == [(1, 0, 5), (1, 1, 6)]
    outer = ExportSpec("t", ("id", "xs_item"), (JoinSpec("t", "LEFT ARRAY JOIN", array_column="xs"),))
    assert rows(compile_export(outer, {"t": df})) == [(1, 5), (1, 6), (2, None), (3, None)]
    kept = joins.array_join(df, F.col("xs"), "x", keep_empty=True).select("id", "x")
    assert rows(kept) == [(1, 5), (1, 6), (2, None), (3, None)]
