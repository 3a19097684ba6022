"""Lookups and listings of crawls and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.operators.ordering import MAX_SALTED, first_n, numbered
from spinneret.operators.results import ID_SHIFT
from spinneret.schemas import CRAWL_COLUMNS, PAGE_COLUMNS, PAGE_COLUMNS_NO_HTML
from spinneret.sources.layout import bucket_of, has_buckets

# The range of a listing page.
DEFAULT_LIMIT, MAX_LIMIT = 50, 500
MAX_OFFSET = 1_000_000


def check_paging(limit: int = DEFAULT_LIMIT, offset: int = 0) -> tuple[int, int]:
    """The limit and offset, or an error when they are out of range."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be between 0 and {MAX_OFFSET}")
    return limit, offset


def parse_bounded(raw: str, default: int, low: int, high: int) -> int:
    """A whole number from text, ``default`` for ``''``; an error if out of range."""
    if raw == "":
        return default
    value = int(raw)
    if not low <= value <= high:
        raise ValueError(f"must be between {low} and {high}")
    return value


def crawl_by_id(crawls: DataFrame, crawl_id: int) -> DataFrame:
    """The crawl, or no row."""
    return crawls.where(F.col("id") == crawl_id).select(*CRAWL_COLUMNS)


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    """The page, or no row. The id holds the crawl, so other buckets are not read."""
    found = pages.where(F.col("id") == page_id)
    if has_buckets(pages):
        found = found.where(F.col("crawl_bucket") == bucket_of(page_id >> ID_SHIFT))
    return found.select(*PAGE_COLUMNS)


def pages_of(pages: DataFrame, crawl_id: int) -> DataFrame:
    found = pages.where(F.col("crawl_id") == crawl_id)
    if has_buckets(pages):
        found = found.where(F.col("crawl_bucket") == bucket_of(crawl_id))
    return found


def count_pages(pages: DataFrame) -> DataFrame:
    """``crawl_id, total`` for every crawl with pages."""
    return pages.groupBy("crawl_id").agg(F.count("*").alias("total"))


def list_pages(
    pages: DataFrame, crawl_id: int, limit: int = DEFAULT_LIMIT, offset: int = 0, with_html: bool = False
) -> DataFrame:
    """One page of a crawl's pages by id. The body is read only if asked for."""
    limit, offset = check_paging(limit, offset)
    rows = pages_of(pages, crawl_id).select(*(PAGE_COLUMNS if with_html else PAGE_COLUMNS_NO_HTML))
    if limit + offset <= MAX_SALTED:
        return rows.orderBy("id").offset(offset).limit(limit)
    # Deep pages: place the ids alone, then fetch at most ``limit`` rows.
    ids = numbered(rows.select("id"), ["id"], name="_place").where(F.col("_place").between(offset + 1, offset + limit))
    return rows.join(F.broadcast(ids.select("id")), "id", "left_semi").orderBy("id")


def list_pages_all(pages: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The same listing page of every crawl at once, with its ``position``."""
    limit, offset = check_paging(limit, offset)
    # narrow rows, and few of them after the cut that comes before the shuffle
    placed = first_n(pages.select(*PAGE_COLUMNS_NO_HTML), "crawl_id", "id", limit + offset)
    # paging is bounded, so a place always fits
    return placed.where(F.col("position") > offset).withColumn("position", F.col("position").cast("int"))


def listing_totals(requests: DataFrame, crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """For ``requests (crawl_id)``: ``crawl_found`` and ``total`` pages.

    Tells a crawl without pages (found, 0) from no such crawl (not found).
    """
    known = crawls.select(F.col("id").alias("crawl_id"), F.lit(True).alias("_found"))
    return (
        requests.select("crawl_id")
        .join(known, "crawl_id", "left")
        .join(count_pages(pages), "crawl_id", "left")
        .select(
            "crawl_id",
            F.coalesce("_found", F.lit(False)).alias("crawl_found"),
            F.when(F.col("_found"), F.coalesce("total", F.lit(0))).alias("total"),
        )
    )


def crawls_by_status(crawls: DataFrame, status: str) -> DataFrame:
    return crawls.where(F.col("status") == status).select(*CRAWL_COLUMNS)


def recent_crawls(crawls: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first; equal start times by id."""
    return crawls.select(*CRAWL_COLUMNS).orderBy(F.col("started_at").desc(), "id").limit(limit)
