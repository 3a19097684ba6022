"""Order-aware building blocks that stay spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinneret.session import pinned

SALTS = 256
# Above this, SALTS partial winners per group are too much for one last task.
MAX_SALTED = 10_000

# monotonically_increasing_id keeps the partition number above this bit.
_ROW_BITS = 33


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep, per key, the smallest ``order`` value: columns ``keys`` and ``order``.

    An aggregate, so copies of one key meet on the map side before the shuffle.
    """
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def first_n(df: DataFrame, group: str, order: str, n: int, name: str = "position") -> DataFrame:
    """Number rows from 1 per ``group`` by ``order`` and keep the first ``n``.

    ``n <= 0`` keeps all. For a small ``n`` a group is cut to ``n`` three times: in
    each task before any shuffle, in each of SALTS sets of tasks, and over all. So
    the last task sees at most SALTS * n rows of it. Which rows share a salt does
    not matter to the result.
    """
    if n <= 0:
        return numbered(df, [order], [group], name)
    if n > MAX_SALTED:
        return numbered(df, [order], [group], name).where(F.col(name) <= n)
    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
    per_salt = Window.partitionBy(group, "_salt").orderBy(order)
    per_group = Window.partitionBy(group).orderBy(order)
    return (
        salted.withColumn(name, F.row_number().over(per_salt))
        .where(F.col(name) <= n)
        .drop("_salt", name)
        .withColumn(name, F.row_number().over(per_group).cast("long"))
        .where(F.col(name) <= n)
    )


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Number all rows from 1 by ``order``, within ``group`` or over the table.

    The rows are range-partitioned and pinned, so that each group lies in a run
    of partitions; its rows in earlier partitions are then counted and added to
    the place within the partition. No task ever holds a whole group.
    """
    keys = [*group, *order]
    laid = pinned(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    row = F.monotonically_increasing_id()
    marked = laid.withColumn("_row", row).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    runs = marked.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    # one row per group and partition: few, however many rows a group has
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start")
    )
    # Null-safe: rows without a group are numbered as a group of their own.
    starts = starts.select("_start", *[F.col(c).alias(f"_of_{i}") for i, c in enumerate([*group, "_part"])])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate([*group, "_part"])]
    return marked.join(starts, same).select(*df.columns, (F.col("_row") + F.col("_start")).alias(name))
