"""Lookup join that spreads the rows of hot keys.

For joins that add little to a row, Spark's own skew join is enough: it splits a
hot partition by its size. ``lookup`` is for joins whose right rows are large (page
bodies) or fan out (lists of URLs), where the size of the left rows says nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.session import pinned_counted

# Numbers that may be broadcast to drop rows by: a few tens of MB.
MAX_BROADCAST_ROWS = 500_000

# Rows of one key that a single task may take, and rows that they may become.
ROWS_PER_SALT = 200_000
ROWS_OUT_PER_SALT = 5_000_000
# Page bodies of one key that a single task may give out.
BODIES_PER_SALT = 2_000
# Rows without a key match nothing; they only need to be spread.
_NULL_SALTS = 1024


def rows_per_task(fan_out: int) -> int:
    """Left rows of one key for a task, when each may become ``fan_out`` rows."""
    return max(1, min(ROWS_PER_SALT, ROWS_OUT_PER_SALT // max(fan_out, 1)))


def hot_keys(df: DataFrame, key: str, per_task: int | None = None) -> DataFrame:
    """``key, _parts``: keys with more than ``per_task`` rows, and their split.

    All of them, however many.
    """
    per_task = per_task or ROWS_PER_SALT
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .where(F.col("count") > per_task)
        .select(key, F.ceil(F.col("count") / per_task).cast("int").alias("_parts"))
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    rows: int | None = None,
    hot: DataFrame | None = None,
    strategy: str | None = None,
    per_task: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds at most one row per ``key``.

    Hot keys of ``left`` are split by a hash of the ``spread`` columns, and only
    their right rows are repeated, once per part. ``per_task`` is how many left rows
    of a key a task may take: few where right rows are heavy. ``rows`` is the size of
    the left side where that is known: too few rows cannot make a key hot. ``hot`` is
    ``hot_keys`` of the left side unless the caller has it already; it is counted and
    broadcast if small. ``strategy`` is a join hint for the left side.
    """
    if rows is not None and rows <= (per_task or ROWS_PER_SALT):
        return (left.hint(strategy) if strategy else left).join(right, key, how)
    hot, size = pinned_counted(hot_keys(left, key, per_task) if hot is None else hot)
    if size <= MAX_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    spread_hash = F.xxhash64(*spread)
    salted_left = (
        left.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.when(F.col(key).isNull(), F.pmod(spread_hash, F.lit(_NULL_SALTS)))
            .when(F.col("_parts").isNotNull(), F.pmod(spread_hash, F.col("_parts")))
            .otherwise(0)
            .cast("int"),
        )
        .drop("_parts")
    )
    if strategy:
        salted_left = salted_left.hint(strategy)
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def without(df: DataFrame, unwanted: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` columns are not in ``unwanted``.

    The unwanted keys are counted first. The usual few are broadcast, so that wide
    rows are not shuffled to find out that they stay; many are joined by shuffle.
    """
    unwanted, size = pinned_counted(unwanted.select(*key))
    if not size:
        return df
    return df.join(F.broadcast(unwanted) if size <= MAX_BROADCAST_ROWS else unwanted, list(key), "left_anti")
