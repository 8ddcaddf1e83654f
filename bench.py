"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: Grouped statistics, metadata projection, ordered batching, joins, segment tables, array columns, kernels, lifecycle.
HEADLINE = (
    "agg01_feature_stats",
    "agg02_checked_stats",
    "prj06_metadata_mode",
    "flt01_metadata_filter",
    "hash02_example_id",
    "prj13_enumerate",
    "win02_batch",
    "win03_padded",
    "join01_attach",
    "agg11_extents",
    "win08_merged",
    "seg01_sliding",
    "fe06_db",
    "fe08_logmel",
    "life02_pipeline",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemill.queries import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(6):  # the first run compiles
            t = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_warm_median", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
