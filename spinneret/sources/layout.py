"""How the pages table is laid out: partitioned by a bucket of the crawl id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Part of the table format: readers compute the bucket of a crawl with it.
PAGE_BUCKETS = 64


def bucket_of(crawl_id: int) -> int:
    return crawl_id % PAGE_BUCKETS


def bucket_column(crawl_id: Column) -> Column:
    return F.pmod(crawl_id, F.lit(PAGE_BUCKETS)).cast("int")


def has_buckets(pages: DataFrame) -> bool:
    return "crawl_bucket" in pages.columns
