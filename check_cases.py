"""Compare cases with DuckDB: ``python check_cases.py [sf_dir] [name prefix ...]``."""

import sys
import traceback

from gradloom.session import build_session
from gradloom.suite import load_cases
from gradloom.suite.checks import compare, duck

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = []
    for name, case in load_cases().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            spent, rows, problem = compare(spark, con, case, sf)
        except Exception as error:
            traceback.print_exc(limit=4)
            spent, rows, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:600]}"
        spark.catalog.clearCache()
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:32s} {rows:8d} rows {spent:6.2f}s {'' if case.sql else '(no oracle)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
