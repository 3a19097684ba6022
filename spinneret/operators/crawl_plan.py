"""Which URLs each crawl will process, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.operators.ordering import first_n

# Fixed value: URLs per crawl unless told otherwise.
MAX_PAGES = 5000
# Sorts after every path a sitemap can give.
_LAST = 2**31 - 1


def crawl_plan(sites: DataFrame, urls: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``crawl_id, position, url``: the first ``max_pages`` URLs of each crawl.

    ``max_pages <= 0`` keeps all. A crawl without URLs gets its website: every
    site adds it as a last candidate, which stays only where it comes first.
    """
    fallback = sites.select("crawl_id", F.col("website").alias("url"), F.array(F.lit(_LAST)).alias("path"))
    candidates = urls.select("crawl_id", "url", "path").unionByName(fallback)
    placed = first_n(candidates, "crawl_id", "path", max_pages)
    return placed.where((F.col("path")[0] != _LAST) | (F.col("position") == 1)).select(
        "crawl_id", F.col("position").cast("int").alias("position"), "url"
    )
