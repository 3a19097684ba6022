"""Per-crawl counts and final status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.functions.predicates import counts_as_success

COUNTERS = ("total_pages", "success_pages", "failed_pages")


def counters() -> list[Column]:
    """Aggregates over page results; total counts results, not stored pages."""
    success = counts_as_success(F.col("status_code"), F.col("error"))
    return [
        F.count("*").cast("int").alias("total_pages"),
        F.count_if(success).cast("int").alias("success_pages"),
        F.count_if(~success).cast("int").alias("failed_pages"),
    ]


def final_status(success: Column, failed: Column) -> Column:
    """Failed only if something failed and nothing succeeded; no results is completed."""
    success, failed = F.coalesce(success, F.lit(0)), F.coalesce(failed, F.lit(0))
    return F.when((failed > 0) & (success == 0), "failed").otherwise("completed")


def rollup(results: DataFrame) -> DataFrame:
    """``crawl_id``, counters and ``status``; reads three columns of the results."""
    return (
        results.groupBy("crawl_id")
        .agg(*counters())
        .withColumn("status", final_status(F.col("success_pages"), F.col("failed_pages")))
    )


def rollup_of(crawls: DataFrame, results: DataFrame) -> DataFrame:
    """The rollup of every crawl in ``crawls (id)``, also those without results."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS]
    counted = results.groupBy("crawl_id").agg(*counters())
    return (
        crawls.select(F.col("id").alias("crawl_id"))
        .join(counted, "crawl_id", "left")
        .select("crawl_id", *zero, final_status(F.col("success_pages"), F.col("failed_pages")).alias("status"))
    )


def failed_rollup(crawls: DataFrame) -> DataFrame:
    """For crawls whose discovery failed: status failed, all counters zero."""
    return crawls.select(
        F.col("id").alias("crawl_id"), *[F.lit(0).alias(c) for c in COUNTERS], F.lit("failed").alias("status")
    )
