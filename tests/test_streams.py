"""Stream queries over small tables of their own."""

from collections import Counter

from workloads import streams


def write_orders(spark, folder, count):
    spark.range(count).selectExpr(
        "id AS o_orderkey",
        "id % 7 AS o_custkey",
        "'F' AS o_orderstatus",
        "id + 0.5D AS o_totalprice",
        "timestamp_ntz'1995-01-01' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")


def test_progress_is_told_of_whole_orders(spark, tmp_path):
    write_orders(spark, tmp_path, 300)
    cells = sum(len(f"{k},{k % 7},F,{k}.5,1995-01-01T00:00:00,1-URGENT\n") for k in range(300))
    header = len("o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority\n")
    assert streams.stream_progress(spark, str(tmp_path)).collect() == [(300, 300, 300, cells + 6 * header)]


def test_larger_documents_arrive_in_more_files(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr(
        "nullif(id % 390, 5) AS doc_id", "if(id % 9 = 0, null, 'one\n\"two\", three') AS text", "'en' AS lang", "'web' AS source", "id AS n_chars"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = []

    def export(rows, path):
        sizes.append(rows.rdd.getNumPartitions())
        return export_delimited(rows, path)

    export_delimited = streams.export_delimited
    monkeypatch.setattr(streams, "export_delimited", export)
    monkeypatch.setattr(streams, "FILE_BYTES", 2400)
    assert Counter(map(tuple, streams.stream_spanning(spark, str(tmp_path)).collect())) == Counter(map(tuple, docs.collect()))
    monkeypatch.undo()
    assert sizes[0] > 4
    assert streams._file_count(docs, 4) == 4 and streams._file_count(docs.where("false"), 4) == 4
