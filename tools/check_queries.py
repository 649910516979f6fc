"""Compare registered queries with their SQL on the same tables.

python tools/check_queries.py [table folder] [name ...]
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import workloads

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return repr(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for name in NAMES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    sql, failed = workloads.all_sql(), []
    for name, query in workloads.all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            rows = df.collect()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(rows)} {took:.2f}s")
                continue
            found = db.execute(sql[name])
            columns = [d[0] for d in found.description]
            types = [str(d[1]) for d in found.description]
            expected = found.fetchall()
            same_names = sorted(columns) == sorted(df.columns)
            same = same_names and bag(df.columns, rows) == bag(columns, expected)
            print(f"{'ok   ' if same else 'DIFF '} {name} {len(rows)}/{len(expected)} {took:.2f}s")
            if not same:
                failed.append(name)
                print("   ", df.columns, columns)
                a, b = bag(df.columns, rows), bag(columns, expected)
                print("    spark only:", [str(x)[:300] for x in list((a - b))[:2]])
                print("    sql only:  ", [str(x)[:300] for x in list((b - a))[:2]])
            mismatch = [(c, t, dict(df.dtypes).get(c)) for c, t in zip(columns, types)]
            if os.environ.get("SHOW_TYPES"):
                print("   ", mismatch)
        except Exception as error:
            failed.append(name)
            print(f"ERROR {name} {type(error).__name__}: {str(error)[:600]}")
    print("failed:", failed)


if __name__ == "__main__":
    main()
