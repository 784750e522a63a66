"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from braidset.plans.registry import QUERIES  # noqa: E402

ROOT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "macro_by_concern",
    "score_cases",
    "evaluation_view",
    "efficiency_by_context",
    "interaction_ols",
    "correlation_table",
    "mann_whitney_u",
    "box_by_context",
    "curate_atomic",
    "split_by_type",
    "combine_cases",
    "truncate_grid",
    "tokens_by_concern",
    "label_combinations",
    "parse_responses",
    "compare_models",
    "live_macro",
)


def run_once(spark, name):
    start = time.perf_counter()
    QUERIES[name](spark, ROOT).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run_once(spark, name)
        times[name] = round(statistics.median(run_once(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(ROOT.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
