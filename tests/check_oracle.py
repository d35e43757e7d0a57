"""Run all (or the named) registered queries that have SQL against it: ``python tests/check_oracle.py sf0.01 [name ...]``."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import oracle  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from twinledger import build_session  # noqa: E402

if __name__ == "__main__":
    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    bad = 0
    for name, query in queries().items():
        if name not in oracle_sql() or sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = oracle.compare(spark, con, folder, query, oracle_sql()[name])
        except Exception as exc:
            problem = f"{type(exc).__name__}: {exc}"[:1200]
        bad += bool(problem)
        print(f"{name:32s} {time.time() - start:6.2f}s {'ok' if not problem else 'DIFF ' + problem}", flush=True)
    print("different:", bad)
