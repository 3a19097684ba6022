"""Live counters per crawl.

The counters that a micro-batch changed are written as they then are, in a folder of
its own under ``updates``. Every so many batches they are folded with the snapshot before
into the next one, of one row a crawl, which an empty file in ``published`` makes the
current one. So what is read does not grow with the number of batches. Updates that a
snapshot holds stay until the next fold, for readers that began before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spinneret.operators.rollup import COUNTERS, counters, final_status
from spinneret.sources import files

_COUNTED = "crawl_id long, total_pages int, success_pages int, failed_pages int"
_BATCH = "batch_id="
# Batches between two snapshots.
FOLD_EVERY = 100


def live_counters(results: DataFrame) -> DataFrame:
    """Running counters of a stream: one state row per crawl."""
    return results.groupBy("crawl_id").agg(*counters())


def count_pages_live(
    results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Write the counters that changed in each micro-batch under ``path``.

    A replayed batch overwrites its own folder, and is not read if a snapshot holds it:
    counters are totals, so it brings the same ones.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/updates/{_BATCH}{batch_id}")
        if batch_id - folded_to(spark, path) >= fold_every:
            fold(spark, path, batch_id)

    return (
        live_counters(results)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def folded_to(spark: SparkSession, path: str) -> int:
    """The last batch that the current snapshot holds; -1 before there is one."""
    return max(map(int, files.names(spark, f"{path}/published")), default=-1)


def _batches(spark: SparkSession, path: str) -> list[int]:
    found = files.names(spark, f"{path}/updates")
    return [int(name.removeprefix(_BATCH)) for name in found if name.startswith(_BATCH)]


def _newest(spark: SparkSession, path: str) -> DataFrame:
    """``crawl_id`` and counters, one row a crawl: the snapshot, and what changed since."""
    folded = folded_to(spark, path)
    whole = spark.createDataFrame([], _COUNTED)
    if folded >= 0:
        whole = spark.read.schema(_COUNTED).parquet(f"{path}/snapshots/{folded}")
    if max(_batches(spark, path), default=-1) <= folded:
        return whole
    since = spark.read.schema(f"{_COUNTED}, batch_id long").parquet(f"{path}/updates").where(F.col("batch_id") > folded)
    both = since.unionByName(whole.withColumn("batch_id", F.lit(folded).cast("long")))
    newest = both.groupBy("crawl_id").agg(F.max_by(F.struct(*COUNTERS), "batch_id").alias("_now"))
    return newest.select("crawl_id", "_now.*")


def fold(spark: SparkSession, path: str, batch_id: int) -> None:
    """Publish a snapshot of all batches up to ``batch_id``, the last that was written.

    A fold that failed is written again. What only readers of the snapshot before the
    last one need is removed.
    """
    before = folded_to(spark, path)
    _newest(spark, path).write.mode("overwrite").parquet(f"{path}/snapshots/{batch_id}")
    files.mark(spark, f"{path}/published/{batch_id}")
    for old in _batches(spark, path):
        if old <= before:
            files.remove(spark, f"{path}/updates/{_BATCH}{old}")
    for name in files.names(spark, f"{path}/snapshots"):
        if int(name) < before:
            files.remove(spark, f"{path}/published/{name}")
            files.remove(spark, f"{path}/snapshots/{name}")


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    """The newest counters of every crawl, with the status they would end in."""
    return _newest(spark, path).withColumn("status", final_status(F.col("success_pages"), F.col("failed_pages")))
