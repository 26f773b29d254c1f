"""Compare registered queries with DuckDB: python -m tests.run_oracle [sf] [name ...]"""

from __future__ import annotations

import sys
import time

from tickloom.catalog import load_all
from tickloom.session import build_session

from .oracle import compare, duck


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]", **{"spark__sql__shuffle__partitions": "8",
                                                "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false",
                                                "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name, q in load_all().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf_dir)
            problem = compare(df, con, q.sql) if q.sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(q.sql and problem)
        print(f"{'ok  ' if not (q.sql and problem) else 'FAIL'} {name} {time.time() - t0:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
