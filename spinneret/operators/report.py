"""What became of each crawl: what its sitemaps gave, what the cap cut, what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.operators.crawl_plan import MAX_PAGES
from spinneret.operators.rollup import COUNTERS, counters


def urls_cut(urls_found: Column, max_pages: int) -> Column:
    """How many of a crawl's URLs its plan leaves out; none without a cap."""
    if max_pages <= 0:
        return F.lit(0).cast("long")
    return F.greatest(urls_found - max_pages, F.lit(0).cast("long"))


def truncated(stats: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``crawl_id, urls_found, urls_cut`` of the crawls that the cap cuts.

    ``stats`` is that of ``discover``.
    """
    cut = stats.select("crawl_id", "urls_found", urls_cut(F.col("urls_found"), max_pages).alias("urls_cut"))
    return cut.where("urls_cut > 0")


def run_report(crawls: DataFrame, stats: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per crawl of a run, with its counters held against the stored pages.

    ``crawls`` are the finished ones, ``stats`` those of ``discover`` and ``pages`` the
    stored rows, of which three columns are read and counted per crawl before anything
    is joined. A crawl without URLs plans its website alone. ``counters_agree`` is false
    where pages are missing or were stored more often than the counters say; pages of
    crawls that are not in ``crawls`` are left out.
    """
    found = F.coalesce("urls_found", F.lit(0).cast("long"))
    cut = urls_cut(found, max_pages)
    stored = pages.groupBy("crawl_id").agg(*counters())
    stored = stored.select("crawl_id", *[F.col(c).alias(f"stored_{c}") for c in COUNTERS])
    agree = [F.col(c) == F.coalesce(f"stored_{c}", F.lit(0)) for c in COUNTERS]
    return (
        crawls.select(F.col("id").alias("crawl_id"), "status", *COUNTERS)
        .join(stats, "crawl_id", "left")
        .join(stored, "crawl_id", "left")
        .select(
            "crawl_id",
            "status",
            found.alias("urls_found"),
            F.greatest(found - cut, F.lit(1).cast("long")).alias("urls_planned"),
            cut.alias("urls_cut"),
            F.coalesce("sitemaps_found", F.lit(0).cast("long")).alias("sitemaps_found"),
            F.coalesce("errors", F.lit(0).cast("long")).alias("discovery_errors"),
            *COUNTERS,
            F.coalesce("stored_total_pages", F.lit(0)).alias("stored_pages"),
            (agree[0] & agree[1] & agree[2]).alias("counters_agree"),
        )
    )
