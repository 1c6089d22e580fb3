"""Time the headline queries: ``BENCH_SF_DIR`` (data), ``BENCH_CPUS`` (threads); one JSON line on stdout.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 3); its figure is the median. Results
are counted inside Spark with every column computed, nothing is collected.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from sluice.plans.registry import QUERIES

HEADLINE = (
    "mask_pii", "mask_summary", "validate_classifications", "check_shape", "token_cost", "intake_outcomes",
    "lifecycle", "correction_fold", "list_page", "field_accuracy", "confidence_stats", "corrected", "field_delta",
    "attempt_resolution", "attempt_accounting", "usage_subtotals", "attempt_log_read", "langid_predict",
    "rubric_labels", "classify_batch",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_once(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = tuple(QUERIES)
    spark = session(cpus)
    seconds = {}
    for name in names:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
