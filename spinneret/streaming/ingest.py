"""Stored pages kept up to date from a stream of page results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spinneret.session import fresh_path
from spinneret.sources.page_table import PageTable
from spinneret.sources.store import insert_new


def ingest_pages(
    results: DataFrame, path: str, checkpoint: str, order: str = "id", trigger: dict | None = None
) -> StreamingQuery:
    """Add streamed page rows to the table at ``path``; the first of a key wins.

    No state is kept: each micro-batch is compared with the keys stored so far,
    which also makes a replayed batch add nothing. ``order`` decides within a
    batch. The default trigger takes what is there and stops.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # read for its keys, then for its rows
        try:
            insert_new(kept, path, order)
        finally:
            kept.unpersist()

    return (
        results.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_into(
    results: DataFrame, table: PageTable, checkpoint: str, order: str = "id", trigger: dict | None = None
) -> StreamingQuery:
    """Add streamed page rows to ``table``; the first of a key wins, stored ones included.

    Each micro-batch is written to the shared folder, compared with the keys of the
    crawls it names, and removed once its new rows are stored. A batch that is tried
    again, after a failure at any point, adds what is missing. No state is kept.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = fresh_path(spark, "micro-batch")
        batch.write.parquet(path)
        table.insert_new(spark.read.schema(batch.schema).parquet(path), order)
        table._remove(path)

    return (
        results.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
