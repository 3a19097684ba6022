"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores. Each query is run once to warm up and then timed; its rows go to Spark's
``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from spinneret.session import prepare  # noqa: E402
from spinneret.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "crawl_rollup",
    "captured_results",
    "page_rows",
    "page_success",
    "failed_discovery",
    "redirect_final",
    "udf_surface",
    "seed_normalise",
    "seed_dedup",
    "sitemap_urls",
    "discovery_stats",
    "crawl_plan",
    "crawl_run",
    "list_pages",
    "list_pages_all",
    "insert_ignore",
    "finalise",
    "delete_cascade",
    "constraint_audit",
    "page_json",
    "stream_ingest",
    "stream_counters",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def seconds(run, spark: SparkSession, sf_dir: str) -> float:
    begin = time.perf_counter()
    result: DataFrame = run(spark, sf_dir)
    result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    times = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, sf_dir)
        times[name] = round(seconds(QUERIES[name], spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
