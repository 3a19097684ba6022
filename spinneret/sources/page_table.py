"""A pages table that batches, streams and deletes change without rewriting it.

A table is a folder of versions. Each version holds

* ``pages``: the rows, partitioned and sorted as in ``store``;
* ``keys``: ``crawl_id, url`` of every row, partitioned by bucket and by span of crawl
  ids and sorted, so that a batch is compared with the keys that it may repeat and
  nothing else: partitions of other crawls are not listed, and in those that are, row
  groups of other crawls are skipped by their statistics;
* ``deleted``: ids of crawls that are gone, which readers leave out.

An empty file in ``published`` makes a version the current one. It is created whole or
not at all, so a reader sees one version; a DataFrame that was read before goes on
reading the old one until ``expire``. One writer at a time.

Rows are written before their keys, with the touched buckets noted in ``open`` in
between. A writer that finds such a note was preceded by one that failed there, and
rebuilds the keys of these buckets from the rows first: so a batch that is tried again
adds what is missing, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinneret.operators.changes import insert_ignore
from spinneret.operators.joins import without
from spinneret.operators.listing import check_paging, pages_of
from spinneret.schemas import PAGE_COLUMNS, PAGE_COLUMNS_NO_HTML, PAGES
from spinneret.session import written
from spinneret.sources import store
from spinneret.sources.layout import bucket_column
from spinneret.sources.tables import read_pages

# Crawls whose keys share a partition. Ids rise, so the crawls at work share few.
SPAN = 1 << 16
# So many crawls or spans of a batch are named in a filter; more are not filtered by.
MAX_NAMED = 1000

_KEYS = T.StructType(
    [
        *[f for f in PAGES.fields if f.name in ("crawl_id", "url")],
        T.StructField("crawl_bucket", T.IntegerType()),
        T.StructField("crawl_span", T.LongType()),
    ]
)
_DELETED = T.StructType([T.StructField("crawl_id", T.LongType())])


def span_column(crawl_id: Column) -> Column:
    return F.floor(crawl_id / SPAN).cast("long")


class PageTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # versions

    def _files(self, path: str):
        return store._path_of(self.spark, path)

    def _names(self, path: str) -> list[str]:
        files, folder = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _remove(self, path: str) -> None:
        files, where = self._files(path)
        files.delete(where, True)

    def version(self) -> int:
        """The number of the current version; 0 before anything was published."""
        return max(map(int, self._names(f"{self.root}/published")), default=0)

    def _at(self, part: str, version: int | None = None) -> str:
        return f"{self.root}/v{self.version() if version is None else version:08d}/{part}"

    def expire(self) -> None:
        """Remove the versions before the current one; nothing may read them any more."""
        current = self.version()
        for name in self._names(self.root):
            if name.startswith("v") and int(name[1:]) < current:
                self._remove(f"{self.root}/{name}")

    # reading

    def _stored(self) -> DataFrame:
        path = self._at("pages")
        if store.table_exists(self.spark, path):
            return read_pages(self.spark, path)
        return self.spark.createDataFrame([], T.StructType([*PAGES.fields, T.StructField("crawl_bucket", T.IntegerType())]))

    def deleted(self) -> DataFrame | None:
        """``crawl_id`` of the crawls deleted since the last ``compact``, if any were."""
        path = self._at("deleted")
        if not store.table_exists(self.spark, path):
            return None
        return self.spark.read.schema(_DELETED).parquet(path).distinct()

    def _present(self, rows: DataFrame) -> DataFrame:
        gone = self.deleted()
        return rows if gone is None else without(rows, gone, "crawl_id")

    def read(self) -> DataFrame:
        """All pages, with the ``crawl_bucket`` that lookups and listings prune by."""
        return self._present(self._stored())

    def keys_near(self, batch: DataFrame) -> DataFrame:
        """``crawl_id, url`` of the stored pages that rows of ``batch`` may repeat."""
        path = self._at("keys")
        if not store.table_exists(self.spark, path):
            return batch.select("crawl_id", "url").limit(0)
        keys = self.spark.read.schema(_KEYS).parquet(path)
        places = batch.select("crawl_id").distinct()
        keys = keys.where(F.col("crawl_bucket").isin(store._touched_buckets(batch)))
        for column, of in (("crawl_span", span_column(F.col("crawl_id"))), ("crawl_id", F.col("crawl_id"))):
            named = [r[0] for r in places.select(of.alias("x")).distinct().limit(MAX_NAMED + 1).collect()]
            if len(named) <= MAX_NAMED:
                keys = keys.where(F.col(column).isin(named))
        return keys.select("crawl_id", "url")

    def list_after(
        self, crawl_id: int, after_id: int | None = None, limit: int = 50, with_html: bool = False
    ) -> DataFrame:
        """The next ``limit`` pages of a crawl by id, from the one after ``after_id`` on.

        Ids are looked up first, then the rows from the first to the last of them:
        bodies of other rows are neither read nor sorted.
        """
        limit, _ = check_paging(limit)
        rows = pages_of(self.read(), crawl_id)
        if after_id is not None:
            rows = rows.where(F.col("id") > after_id)
        last = rows.select("id").orderBy("id").limit(limit).agg(F.max("id")).first()[0]
        rows = rows.where(F.col("id") <= (last if last is not None else -1)) if last is not None else rows.limit(0)
        return rows.select(*(PAGE_COLUMNS if with_html else PAGE_COLUMNS_NO_HTML))

    # writing

    def _write_keys(self, keys: DataFrame, version: int | None = None) -> None:
        (
            keys.select("crawl_id", "url")
            .withColumn("crawl_bucket", bucket_column(F.col("crawl_id")))
            .withColumn("crawl_span", span_column(F.col("crawl_id")))
            .hint("rebalance", "crawl_bucket", "crawl_span")
            .sortWithinPartitions("crawl_bucket", "crawl_span", "crawl_id", "url")
            .write.mode("append")
            .partitionBy("crawl_bucket", "crawl_span")
            .parquet(self._at("keys", version))
        )

    def _note(self, buckets: list[int]) -> str:
        path = self._at("open")
        for bucket in buckets:
            files, where = self._files(f"{path}/{bucket}")
            files.create(where, True).close()
        return path

    def repair(self) -> None:
        """Rebuild the keys of buckets that a failed writer left open."""
        buckets = [int(name) for name in self._names(self._at("open")) if name.isdigit()]
        if buckets:
            for bucket in buckets:
                self._remove(f"{self._at('keys')}/crawl_bucket={bucket}")
            self._write_keys(self._stored().where(F.col("crawl_bucket").isin(buckets)))
            self._remove(self._at("open"))

    def insert_new(self, batch: DataFrame, order: str = "id") -> None:
        """Append the rows whose (crawl_id, url) the table does not have yet.

        Give a stored batch: it is read more than once. Of rows that share a key the
        first by ``order`` stays. Late pages of deleted crawls are not stored. The
        same batch again adds nothing.
        """
        self.repair()
        batch = self._present(batch)
        near = written(self.keys_near(batch), "near-keys")
        new = insert_ignore(batch, near, order)
        keys = batch.select("crawl_id", "url").distinct().join(near.hint("merge"), ["crawl_id", "url"], "left_anti")
        note = self._note(store._touched_buckets(batch))
        store._write_pages(new, self._at("pages"), "append")
        self._write_keys(keys)
        self._remove(note)

    def delete(self, ids: DataFrame) -> None:
        """Delete the pages of the crawls in ``ids (id)``; no page file is touched."""
        gone = ids.select(F.col("id").cast("long").alias("crawl_id")).where("crawl_id IS NOT NULL").distinct()
        gone.write.mode("append").parquet(self._at("deleted"))

    def compact(self) -> None:
        """Write the next version, without what was deleted, and publish it.

        Crawl ids are not given twice, so a compacted table may forget which are gone.
        """
        self.repair()
        following = self.version() + 1
        self._remove(f"{self.root}/v{following:08d}")  # of a fold that failed
        rows = self.read()
        store._write_pages(rows, self._at("pages", following), "append")
        self._write_keys(rows, following)
        files, mark = self._files(f"{self.root}/published/{following}")
        files.create(mark, False).close()
