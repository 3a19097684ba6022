"""Updates and deletes, as DataFrames of the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.operators.joins import without
from spinneret.operators.ordering import first_per_key
from spinneret.operators.rollup import COUNTERS
from spinneret.schemas import CRAWL_COLUMNS


def finalise(crawls: DataFrame, totals: DataFrame, now: Column | None = None) -> DataFrame:
    """Crawls with the totals, status and end time of ``totals`` written in.

    ``totals`` is a rollup. Crawls it does not name stay as they are.
    """
    now = F.current_timestamp() if now is None else now
    ended = totals.select(
        F.col("crawl_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in ("status", *COUNTERS)],
        F.lit(True).alias("_ended"),
    )
    return crawls.join(ended, "id", "left").select(
        "id",
        "website",
        *[F.coalesce(f"_{c}", c).alias(c) for c in ("status", *COUNTERS)],
        "started_at",
        F.when(F.col("_ended"), now.cast("timestamp")).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def set_status(crawls: DataFrame, requests: DataFrame) -> DataFrame:
    """Crawls with the statuses of ``requests (id, status)``.

    Of several requests for one id that with the largest status in code point order
    holds, so a crawl is never repeated.
    """
    wanted = requests.groupBy("id").agg(F.max("status").alias("_status"))
    updated = crawls.join(wanted, "id", "left").withColumn("status", F.coalesce("_status", "status"))
    return updated.select(*CRAWL_COLUMNS)


def not_found(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Requested ids that the table does not have."""
    return requests.select("id").join(table, "id", "left_anti")


def delete_crawls(crawls: DataFrame, ids: DataFrame) -> DataFrame:
    """Crawls without those in ``ids (id)``."""
    return crawls.join(ids, "id", "left_anti")


def delete_pages_of(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages without those of the crawls in ``ids (id)``: the cascade."""
    return pages.join(ids.select(F.col("id").alias("crawl_id")), "crawl_id", "left_anti")


def insert_ignore(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Rows of ``batch`` to add to a table unique by (crawl_id, url).

    Rows whose key ``existing`` has are dropped; of several with one key the first by
    ``order`` stays, whether or not other rows share its value. Rows that tie there are
    told apart by a hash of the whole row; of rows that are equal in all columns one
    stays. The rows to drop are worked out on narrow columns, so wide rows only move if
    there are many to drop, or to tell equal ones apart. Keys are joined by shuffle: their
    files are far smaller than they are, so Spark would send many to the driver to broadcast.
    """
    keys = ["crawl_id", "url"]
    columns = batch.columns
    marked = batch.withColumn("_row", F.xxhash64(*columns))
    narrow = marked.groupBy(*keys, order, "_row").agg(F.count(F.lit(1)).alias("_copies"))
    best = narrow.groupBy(*keys).agg(F.min(F.struct(order, "_row", "_copies")).alias("_best"))
    new = best.select(*keys, "_best.*").join(existing.select(*keys).hint("merge"), keys, "left_anti").select(*keys, "_row", "_copies")
    kept = without(marked, narrow.join(new.hint("merge"), [*keys, "_row"], "left_anti").select(*keys, "_row"), *keys, "_row")
    twins = new.where("_copies > 1").select(*keys)
    single = without(kept, twins, *keys)
    if single is kept:
        return kept.select(*columns)
    return single.unionByName(kept.join(twins, keys, "left_semi").dropDuplicates(keys)).select(*columns)
