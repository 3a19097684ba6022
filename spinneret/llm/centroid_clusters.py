"""Clusters of vectors by equal-average equal-variance search for the nearest centroid.

Vectors are whole numbers. Of a vector x with component sum S and deviation
A = sqrt(d |x|^2 - S^2), and a centroid with T and B, the squared distance times d is at
least (S - T)^2 + (A - B)^2. Centroids are sorted by their sums; a vector scans them
outward from its own sum, stops where (S - T)^2 alone exceeds the best distance so far,
passes over centroids that both terms exclude, and computes the exact whole-number
distance of the rest. Bounds are floating-point and held a little too low, so nothing
that could win or tie is ever passed over.

Each round is one pass over the vectors: every task sums its vectors by centroid, and the
sums are added up in Spark. The driver holds the centroids only (k of them, a parameter).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import Scratch
from spinneret.llm.vectors import lists, matrix, summed, vector_batches, whole_numbers

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3

_FAR = np.iinfo(np.int64).max
# Bounds are taken this share lower than computed.
_SLACK = 1e-9

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Search:
    """Nearest of some centroids, rows of whole numbers; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), total))
        self.centroids, self.total = centroids[self.number], total[self.number]
        self.deviation = _deviation(self.centroids)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance for each row, and how many distances were computed."""
        n, d = x.shape
        k = len(self.total)
        total, deviation = x.sum(1), _deviation(x)
        right = np.searchsorted(self.total, total)
        left = right - 1
        best, found = np.full(n, _FAR), np.full(n, k)
        live, computed = np.arange(n), 0
        while len(live):
            below, above = left[live], right[live]
            gap_below = np.where(below >= 0, total[live] - self.total[below], _FAR)
            gap_above = np.where(above < k, self.total[np.minimum(above, k - 1)] - total[live], _FAR)
            down = gap_below <= gap_above
            gap = np.minimum(gap_below, gap_above)
            mean_bound = gap.astype(float) ** 2 / d * (1 - _SLACK)
            on = (gap != _FAR) & (mean_bound <= best[live])
            live, down, mean_bound = live[on], down[on], mean_bound[on]
            place = np.where(down, below[on], above[on])
            left[live[down]] -= 1
            right[live[~down]] += 1
            spread = np.abs(deviation[live] - self.deviation[place])
            spread = np.maximum(spread - _SLACK * (1 + deviation[live] + self.deviation[place]), 0)
            near = mean_bound + spread**2 / d * (1 - _SLACK) <= best[live]
            ask, place = live[near], place[near]
            computed += len(ask)
            squared = ((x[ask] - self.centroids[place]) ** 2).sum(1)
            number = self.number[place]
            better = (squared < best[ask]) | ((squared == best[ask]) & (number < found[ask]))
            best[ask[better]], found[ask[better]] = squared[better], number[better]
        return found, best, computed


def _deviation(x: np.ndarray) -> np.ndarray:
    """Root of the number of components times the squared distance from the mean."""
    return np.sqrt(x.shape[1] * ((x - x.mean(1, keepdims=True)) ** 2).sum(1))


def _sums(whole: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors nearest to each centroid and their componentwise sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(centroids), len(centroids)
        total, count = np.zeros_like(centroids), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch, "x")
            more = summed(x, search.nearest(x)[0], k)
            total, count = total + more[0], count + more[1]
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(count[there], pa.int64()), lists(total[there], pa.int64())],
            ["cluster", "n", "total"],
        )

    parts = whole.select("x").mapInArrow(partial, "cluster int, n long, total array<long>")
    # One row for each centroid and component; sums of sums may pass 64 bits.
    rows = (
        parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r["cluster"], (r["n"], [0] * centroids.shape[1]))[1][r["place"]] = int(r["total"])
    return found


def centroid_clusters(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: str = "1",
) -> DataFrame:
    """Cluster and squared distance of every vector of ``vectors (vec_id, embedding)``.

    Kept are vectors with exactly ``components`` components, none null or non-finite;
    components become ``floor(scale * x)``. The first centroids are the ``k`` vectors
    with the smallest SHA-256 of ``seed:vec_id``; of vectors that repeat an id, those
    with smaller components come first, and those without an id come last. Fewer than
    ``k`` vectors are as many centroids. Equal distances go to the smaller number;
    centroids that no vector is nearest to stay as they are. One row comes out for each
    kept row, repeated ids included; an empty table, or one without such vectors, gives
    no rows. Other columns are ignored, whatever their names. A component beyond 2^23
    after scaling raises an error.
    """
    spark = vectors.sparkSession
    vector_batches(spark)
    scratch = Scratch(spark)
    whole = whole_numbers(vectors.where(F.size("`embedding`") == components), scale)
    whole = scratch.write(whole, "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.select(order.alias("hash"), "x").orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        scratch.drop(whole)
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        before, centroids = centroids, centroids.copy()
        for number, (n, total) in _sums(whole, before).items():
            centroids[number] = [x // n for x in total]
        if (before == centroids).all():
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            found, squared, _ = search.nearest(matrix(batch, "x"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(squared, pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    placed = scratch.write(whole.mapInArrow(assign, "vec_id long, cluster int, distance long"), "cluster-placed")
    scratch.drop(whole)
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    total = sum(r["inertia"] for r in inertia)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(r["cluster"], r["inertia"], total, digest[r["cluster"]]) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row for each of the k centroids.
    return placed.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
