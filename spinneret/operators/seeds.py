"""From raw website strings to new crawl rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.functions.predicates import is_terminal
from spinneret.functions.urls import checked_website
from spinneret.operators.ordering import first_per_key, numbered
from spinneret.schemas import CRAWL_COLUMNS


def check_seeds(seeds: DataFrame) -> DataFrame:
    """Add ``website`` (null if refused) and ``reject_reason`` (null if accepted)."""
    checked = seeds.withColumn("_checked", checked_website(F.col("website_raw")))
    return checked.select(*seeds.columns, "_checked.website", "_checked.reject_reason")


def accepted_seeds(seeds: DataFrame) -> DataFrame:
    return check_seeds(seeds).where(F.col("reject_reason").isNull()).select("seed_id", "website")


def rejected_seeds(seeds: DataFrame) -> DataFrame:
    return check_seeds(seeds).where(F.col("reject_reason").isNotNull()).select(
        "seed_id", "website_raw", "reject_reason"
    )


def in_flight(crawls: DataFrame) -> DataFrame:
    """Per website, the newest crawl that has not ended: ``website, crawl_id``."""
    return (
        crawls.where(~is_terminal(F.col("status")))
        .groupBy("website")
        .agg(F.max("id").alias("crawl_id"))
    )


def assign_seeds(accepted: DataFrame, crawls: DataFrame) -> DataFrame:
    """Per website asked for: its first seed, and the crawl in flight or null."""
    return first_per_key(accepted, ["website"], "seed_id").join(in_flight(crawls), "website", "left")


def reused_crawls(accepted: DataFrame, crawls: DataFrame) -> DataFrame:
    """Crawls in flight that answer a seed, so that no new one starts."""
    wanted = accepted.select("website").distinct()
    ids = in_flight(crawls).join(wanted, "website", "left_semi").select(F.col("crawl_id").alias("id"))
    return crawls.join(ids, "id", "left_semi").select(*CRAWL_COLUMNS)


def new_crawls(accepted: DataFrame, crawls: DataFrame, now: Column | None = None) -> DataFrame:
    """A pending crawl for each website without one in flight.

    Ids go on from the highest existing one, in the order of the seeds.
    """
    now = F.current_timestamp() if now is None else now
    fresh = assign_seeds(accepted, crawls).where(F.col("crawl_id").isNull()).select("website", "seed_id")
    last = crawls.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return numbered(fresh, ["seed_id"], name="_place").select(
        (F.col("_place") + last).alias("id"),
        "website",
        F.lit("pending").alias("status"),
        F.lit(0).alias("total_pages"),
        F.lit(0).alias("success_pages"),
        F.lit(0).alias("failed_pages"),
        now.cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
