"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: the tables (default sf0.1); BENCH_CPUS: local threads. Each query
runs once to warm up and is then timed once, collecting its rows."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.queries import QUERIES, bench_queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "1m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    picked = ("grouped_chain", "pricing_summary", "window_ranking", "window_aggregates", "nearest_neighbours", "not_in_subquery", "related_through", "keyset_page")
    todo = bench_queries() | {k: QUERIES[k] for k in picked}
    took = {}
    for name, q in todo.items():
        q(spark, sf_dir).collect()
        began = time.perf_counter()
        q(spark, sf_dir).collect()
        took[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "total_seconds_warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
