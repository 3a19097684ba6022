"""Table rules checked as queries: every violation is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spinneret.operators.joins import without
from spinneret.schemas import CRAWL_STATUSES, CRAWLS, PAGES


def _violations(rows: DataFrame, rule: str, key, count=None) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("row_key"),
        (F.lit(1) if count is None else count).cast("long").alias("row_count"),
    )


def _nulls(df: DataFrame, table: str, schema: StructType) -> DataFrame:
    """One pass over the table: a row per null in a column that must have a value."""
    required = [f.name for f in schema.fields if not f.nullable]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return df.select(F.col("id"), F.explode(missing).alias("column")).select(
        F.concat(F.lit(f"{table}.not_null."), "column").alias("rule"),
        F.col("id").cast("string").alias("row_key"),
        F.lit(1).cast("long").alias("row_count"),
    )


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """``crawl_id, url, count`` of keys that occur more than once."""
    return pages.groupBy("crawl_id", "url").count().where(F.col("count") > 1)


def orphan_crawl_ids(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """``crawl_id, count`` of pages whose crawl does not exist.

    Pages are counted per crawl first, so that only counts are joined.
    """
    return (
        pages.groupBy("crawl_id").count().join(crawls.select(F.col("id").alias("crawl_id")), "crawl_id", "left_anti")
    )


def pages_with_crawl(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """Pages that belong to an existing crawl.

    The unknown crawl ids are worked out first, usually few; the wide rows are then
    only tested against those.
    """
    return without(pages, orphan_crawl_ids(pages, crawls), "crawl_id")


def audit(crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """``rule, row_key, row_count`` for every broken rule of both tables."""
    bad_status = crawls.where(~F.col("status").isin(*CRAWL_STATUSES))
    crawl_copies = crawls.groupBy("id").count().where(F.col("count") > 1)
    page_copies = pages.groupBy("id").count().where(F.col("count") > 1)
    repeated = duplicate_pages(pages)
    orphans = orphan_crawl_ids(pages, crawls)
    parts = [
        _nulls(crawls, "crawls", CRAWLS),
        _nulls(pages, "pages", PAGES),
        _violations(bad_status, "crawls.status", F.col("id")),
        _violations(crawl_copies, "crawls.id_unique", F.col("id"), F.col("count")),
        _violations(page_copies, "pages.id_unique", F.col("id"), F.col("count")),
        _violations(
            repeated, "pages.url_per_crawl", F.concat_ws(" ", "crawl_id", "url"), F.col("count")
        ),
        _violations(orphans, "pages.crawl_exists", F.col("crawl_id"), F.col("count")),
    ]
    return reduce(DataFrame.unionByName, parts)
