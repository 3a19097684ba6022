"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A "first n" window trims before its shuffle only below this many rows;
    # the default of 1,000 is under the usual 5,000 URLs per crawl.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # Rows hold whole page bodies: keep few of them between Spark and Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on; all can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without it; there a temporary folder serves.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spinneret-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: same rows in the same partitions on every later read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _counted(df: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """What ``keep`` returns, and the number of rows, counted on the way.

    A task that ran twice may be counted twice, so take it as an upper bound; zero
    is exact.
    """
    seen = Observation()
    kept = keep(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return kept, seen.get["rows"]


def pinned_counted(df: DataFrame) -> tuple[DataFrame, int]:
    return _counted(df, pinned)


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, columns still prune."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def written_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    return _counted(df, lambda observed: written(observed, label))
