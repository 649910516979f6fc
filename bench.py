"""Time the headline queries and print one JSON line.

Each query runs once over the smallest tables first, untimed. Scans and loads
write the files that they read, which counts.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowferry.session import build_session  # noqa: E402

HEADLINE = (
    "scan_pipe",
    "scan_csv",
    "scan_csv_selected",
    "scan_lenient",
    "infer_types",
    "validate_types",
    "candidate_keys",
    "column_inventory",
    "validate_width",
    "detect_delimiter",
    "export_roundtrip",
    "export_three_tables",
    "export_json",
    "export_parquet",
    "load_all_columns",
    "load_with_bad_rows",
    "join_inner",
    "join_full",
    "join_any",
    "join_semi",
    "join_chain",
    "join_theta",
    "join_full_hot",
    "array_join",
    "topk_groups",
    "limit_export_large",
    "cast_int",
    "stream_load",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workloads import all_queries

    queries = all_queries()
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    # Start-up cost of the session, and of compiling a query's code, is not part of it.
    warm = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001"))
    seconds = {}
    for name in chosen:
        if os.path.isdir(warm):
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
