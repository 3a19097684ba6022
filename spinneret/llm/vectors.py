"""What the vector operators share: whole-number vectors, and matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Components of whole-number vectors. Squared distances, and their products with
# up to 256 components, stay exact in 64 bits below it.
LARGEST = 1 << 23


def vector_batches(spark: SparkSession) -> None:
    """Vectors are narrow: many rows a batch, bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def finite(vector: Column) -> Column:
    """Whether there is a vector and all its components are numbers; never null."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def whole_numbers(vectors: DataFrame, scale: int, *others: str) -> DataFrame:
    """``vec_id, *others, x``: finite vectors as whole numbers ``floor(scale * component)``.

    Raises an error on components that do not fit (``LARGEST``).
    """
    vector = F.col("`embedding`").cast("array<double>")
    x = F.transform(vector, lambda v: F.floor(v * scale))
    wide = F.exists(x, lambda v: (v > LARGEST) | (v < -LARGEST))
    checked = F.when(wide, F.raise_error(F.lit(f"vector component beyond {LARGEST}"))).otherwise(x)
    return vectors.where(finite(vector)).select(
        F.col("`vec_id`").cast("long").alias("vec_id"),
        *[F.col(f"`{c}`").alias(c) for c in others],
        checked.cast("array<int>").alias("x"),
    )


def matrix(batch: pa.RecordBatch, column: str, kind=np.int64) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(batch.num_rows, -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(rows.ravel(), kind))


def summed(rows: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of each owner ``0 .. k-1``, and their number."""
    total = np.zeros((k, rows.shape[1]), np.int64)
    count = np.bincount(owner, minlength=k)
    if len(rows):
        order = np.argsort(owner, kind="stable")
        there = np.flatnonzero(count)
        starts = np.concatenate(([0], np.cumsum(count[there])[:-1]))
        total[there] = np.add.reduceat(rows[order], starts, axis=0)
    return total, count
