"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores.
Each query is planned and run in full (results are thrown away by the no-op sink) and timed at the
better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinledger import build_session, catalog  # noqa: E402

HEADLINE = [
    "key_analysis_order_line",
    "key_analysis_negative_list",
    "join_lookup",
    "join_base",
    "join_promiscuous",
    "reconcile_detail",
    "reconcile_summary",
    "reconcile_numeric_key",
    "agg_many_specs",
    "agg_sum_mixed_text",
    "agg_concatenate",
    "pivot_sum",
    "pivot_count_unique",
    "compare_many",
    "compare_date_text",
    "de_aggregate_lines",
    "flatten_explode",
    "flatten_ancestors",
    "convert_types",
    "message_reassemble",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "twinledger-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
