"""Runs registered queries against their SQL twins: python tests/check_queries.py [prefix ...] [--sf DIR]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, duck  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        args = args[:i] + args[i + 2:]
    import __spark_entry__ as e
    from trustwatch.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8, extra={
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/spark-warehouse-tw"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = []
    names = [n for n in qs if not args or any(n == a or n.startswith(a) for a in args)]
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            if n in sqls:
                diff = compare(df, sqls[n], con)
                rows = ""
            else:
                diff = []
                rows = f" rows={df.count()} (no sql)"
            t1 = time.time() - t0
            print(f"{'ok  ' if not diff else 'DIFF'} {n} {t1:.1f}s{rows} {'; '.join(diff)[:900]}", flush=True)
            if diff:
                bad.append(n)
        except Exception as ex:  # noqa: BLE001
            bad.append(n)
            msg = str(ex)
            print(f"FAIL {n} {type(ex).__name__}: {msg[:1200]}", flush=True)
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
    print(f"{len(names) - len(bad)}/{len(names)} fine; bad: {bad}")


if __name__ == "__main__":
    main()
