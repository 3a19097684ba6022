"""Writing the crawls and pages tables.

Plain Parquet has no UPDATE or DELETE. Crawls are small and each change writes a
new folder; pages are changed one bucket at a time, through a copy in the shared
folder, so that nothing is overwritten while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.operators.audit import duplicate_pages
from spinneret.operators.changes import delete_pages_of, insert_ignore
from spinneret.schemas import CRAWL_COLUMNS, PAGE_COLUMNS
from spinneret.session import written
from spinneret.sources.layout import bucket_column
from spinneret.sources.tables import read_pages


class DuplicatePages(ValueError):
    """A batch repeats a (crawl_id, url); nothing of it was written."""


def write_crawls(crawls: DataFrame, path: str) -> None:
    """Write a version of the crawls table; the path must be new."""
    crawls.select(*CRAWL_COLUMNS).write.mode("errorifexists").parquet(path)


def _write_pages(pages: DataFrame, path: str, mode: str) -> None:
    laid = (
        pages.select(*PAGE_COLUMNS)
        .withColumn("crawl_bucket", bucket_column(F.col("crawl_id")))
        # Even files per bucket: small ones are merged and large ones split.
        .hint("rebalance", "crawl_bucket")
        # Ids rise within a crawl, so a crawl or a page is found by row-group statistics.
        .sortWithinPartitions("crawl_bucket", "id")
    )
    (
        laid.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("crawl_bucket")
        .parquet(path)
    )


def _touched_buckets(crawl_ids: DataFrame) -> list[int]:
    """Bucket numbers of the crawls: at most PAGE_BUCKETS of them."""
    return [r[0] for r in crawl_ids.select(bucket_column(F.col("crawl_id"))).distinct().collect()]


def _path_of(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def table_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _path_of(spark, path)
    return files.exists(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, folder = _path_of(spark, path)
    return files.exists(folder) and files.getFileStatus(folder).isDirectory()


def append_batch(batch: DataFrame, path: str) -> None:
    """Append a whole batch, or nothing: a repeated key fails it."""
    spark = batch.sparkSession
    keys = batch.select("crawl_id", "url")
    if table_exists(spark, path):
        in_reach = F.col("crawl_bucket").isin(_touched_buckets(keys))
        stored = read_pages(spark, path).where(in_reach).select("crawl_id", "url")
        keys = keys.unionByName(stored.join(keys, ["crawl_id", "url"], "left_semi"))
    if not duplicate_pages(keys).isEmpty():
        raise DuplicatePages(f"batch repeats pages; nothing appended to {path}")
    _write_pages(batch, path, "append")


def insert_new(batch: DataFrame, path: str, order: str = "id") -> None:
    """Append the rows whose (crawl_id, url) the table does not have yet.

    Only the buckets the batch touches are read, and only their keys. Running the
    same batch again adds nothing.
    """
    spark = batch.sparkSession
    if table_exists(spark, path):
        in_reach = F.col("crawl_bucket").isin(_touched_buckets(batch))
        existing = read_pages(spark, path).where(in_reach).select("crawl_id", "url")
    else:
        existing = batch.select("crawl_id", "url").limit(0)
    _write_pages(insert_ignore(batch, existing, order), path, "append")


def delete_stored_pages(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete the pages of the crawls in ``ids (id)``; other buckets stay as they are."""
    buckets = _touched_buckets(ids.select(F.col("id").alias("crawl_id")))
    affected = read_pages(spark, path).where(F.col("crawl_bucket").isin(buckets))
    kept = written(delete_pages_of(affected, ids).select(*PAGE_COLUMNS), "kept-pages")
    left = set(_touched_buckets(kept))
    _write_pages(kept, path, "overwrite")
    # A dynamic overwrite leaves partitions alone that get no rows.
    for bucket in set(buckets) - left:
        files, folder = _path_of(spark, f"{path}/crawl_bucket={bucket}")
        files.delete(folder, True)
