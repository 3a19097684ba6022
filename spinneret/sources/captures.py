"""Captured responses stored by URL, so that joins on the URL leave the bodies in place.

A store is a folder: ``data`` holds the first capture of every URL, bucketed by URL and
sorted within files; a file in ``buckets`` names their number. Later captures of a URL
are never asked for, so they are not kept: no bucket fills up with copies of one URL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.operators.joins import without
from spinneret.operators.ordering import first_per_key
from spinneret.schemas import CAPTURES
from spinneret.session import written
from spinneret.sources import store

BUCKETS = 64


class CaptureStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """``buckets`` counts for a new folder only. Take so many that a bucket of
        bodies is worth a task: a bucket is read as a whole."""
        self.spark, self.root = spark, root.rstrip("/")
        files, folder = store._path_of(spark, f"{self.root}/buckets")
        if not files.exists(folder):
            store._path_of(spark, f"{self.root}/buckets/{buckets}")[0].create(
                store._path_of(spark, f"{self.root}/buckets/{buckets}")[1], False
            ).close()
        self.buckets = max(int(s.getPath().getName()) for s in files.listStatus(folder))
        self.table = f"captures_{uuid.uuid4().hex}"
        if store.table_exists(spark, f"{self.root}/data"):
            self._declare()

    def _declare(self) -> None:
        """Make the folder known to this session as a bucketed table."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CAPTURES.fields)
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (url) SORTED BY (url) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/data'"
        )

    def read(self) -> DataFrame:
        """All captures, one a URL, partitioned by URL."""
        if not self.spark.catalog.tableExists(self.table):
            return self.spark.createDataFrame([], CAPTURES)
        return self.spark.table(self.table)

    def append(self, captures: DataFrame) -> None:
        """Add the first capture of each URL that the store does not have yet.

        Give a stored batch: its ids are read before its bodies.
        """
        narrow = captures.select("url", "capture_id")
        known = self.spark.catalog.tableExists(self.table)
        new = narrow.join(self.read().select("url"), "url", "left_anti") if known else narrow
        first = written(first_per_key(new, ["url"], "capture_id"), "first-captures")
        later = narrow.join(first, ["url", "capture_id"], "left_anti")
        (
            without(captures, later, "capture_id")
            .select(*CAPTURES.fieldNames())
            .repartition(self.buckets, "url")
            .sortWithinPartitions("url")
            .write.mode("append")
            .bucketBy(self.buckets, "url")
            .sortBy("url")
            .option("path", f"{self.root}/data")
            .saveAsTable(self.table)
        )

    def close(self) -> None:
        """Forget the table of this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
