"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["a1_read_delimited", "c1_column_kinds_orders", "e1_global_stats", "e9_corr_matrix", "f6_plausibility", "f11_stuck", "f15_duplicate_rows", "f17_gap",
            "g10_active_rule_episodes", "i9_best_split", "j3_robust_z", "k2_segments", "k8_onsets", "l1_auroc", "m4_judge", "n2_verify_chain", "n10_search"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from trustwatch.plans import views as V
    from trustwatch.plans.catalog import QUERIES
    from trustwatch.session import build_session

    spark = build_session("bench", f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp"), "spark.sql.warehouse.dir": "/tmp/spark-warehouse-tw"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, fn) -> None:
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("ingest_sensor_wide", lambda: V.sensor_wide(spark, sf))
    timed("ingest_dirty_wide", lambda: V.dirty_wide(spark, sf))
    timed("ingest_sensor_long", lambda: V.sensor_long(spark, sf))
    only = os.environ.get("BENCH_ONLY")
    for name in HEADLINE:
        if not only or name in only.split(","):
            timed(name, lambda n=name: QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
