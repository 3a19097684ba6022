"""Product-quantised codes of vectors, with codebooks learnt by ball k-means.

Vectors are whole numbers and cut into equal parts; each part position has a codebook.
The parts that an entry holds form a ball around it, whose radius is the distance of the
farthest of them. Only entries within twice the radius can take a part from the ball:
its neighbours. A part at distance r from its entry can only go to neighbours within 2 r
of the entry: parts with none within 2 r are in the stable core and skip the search, and
the others lie in annular rings, cut by the neighbours in order of their distance, and
are compared with the neighbours up to their ring only. Distances are exact whole
numbers, so nothing is approximated.

Each round is a pass that assigns every part and writes the codes beside the vectors,
and one that adds up parts and radii by entry. Radii after an update are the old ones
plus the way that the entry moved. The driver holds the codebooks only.
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
from spinneret.operators.joins import MAX_BROADCAST_ROWS

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

# Rings are searched together by this many neighbours.
_RING = 32
_MOST = np.iinfo(np.int64).max

RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


class Balls:
    """The entries of one part position, their balls and neighbours.

    ``radius`` bounds the distance of the parts that an entry holds; None: any.
    """

    def __init__(self, entries: np.ndarray, radius: np.ndarray | None = None):
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(between, _MOST)
        self.order = np.argsort(between, axis=1, kind="stable")[:, : len(entries) - 1]
        self.between = np.take_along_axis(between, self.order, 1)
        if radius is None:
            self.neighbours = np.full(len(entries), len(entries) - 1)
        else:
            # A little more than twice the radius: the bound is floating-point.
            reach = 4.0 * (radius * (1 + 1e-9) + 1e-6) ** 2
            self.neighbours = (self.between <= reach[:, None]).sum(1)

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each part, given an entry that holds it.

        Ties go to the lower entry. Also how many distances were computed.
        """
        code, k = code.copy(), len(self.entries)
        own = ((x - self.entries[code]) ** 2).sum(1)
        computed = len(x)
        by_entry = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=k)
        ends = np.cumsum(counts)
        best = own * k + code
        # Floating-point products are exact while all sums stay below 2^53.
        largest = max(np.abs(x).max(initial=0), np.abs(self.entries).max())
        kind = np.float64 if int(largest) ** 2 * x.shape[1] * 4 < 1 << 53 else np.int64
        held, size = self.entries.astype(kind), (self.entries**2).sum(1)
        for entry in np.flatnonzero(counts):
            members = by_entry[ends[entry] - counts[entry] : ends[entry]]
            near = self.between[entry, : self.neighbours[entry]]
            ring = np.searchsorted(near, 4 * own[members], "right")
            out = ring > 0  # the others are in the stable core
            members, ring = members[out], -(-ring[out] // _RING)
            for annulus in np.unique(ring):
                these = members[ring == annulus]
                candidates = self.order[entry, : min(annulus * _RING, self.neighbours[entry])]
                part = x[these]
                cross = part.astype(kind) @ held[candidates].T
                squared = (part**2).sum(1)[:, None] + size[candidates][None, :] - 2 * cross.astype(np.int64)
                computed += squared.size
                best[these] = np.minimum(best[these], (squared * k + candidates).min(1))
        return best % k, best // k, computed


def _parts(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Vectors cut into parts, shorter ones padded with zeros."""
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _padded(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    column = batch.column("x")
    lengths = np.diff(column.offsets.to_numpy())
    if batch.num_rows and (lengths == lengths[0]).all():
        return _parts(matrix(batch, "x") if lengths[0] else np.zeros((batch.num_rows, 0), np.int64), parts, width)
    x = np.zeros((batch.num_rows, parts * width), np.int64)
    for row, found in zip(x, column.to_pylist(), strict=True):
        row[: len(found)] = found
    return x.reshape(batch.num_rows, parts, width)


def _assigned(whole: DataFrame, books: list[Balls], parts: int, width: int) -> DataFrame:
    """``whole`` with the codes of its vectors and their errors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, before = _padded(batch, parts, width), matrix(batch, "codes")
            found = [book.assign(x[:, p], before[:, p])[:2] for p, book in enumerate(books)]
            codes, error = (np.stack([f[i] for f in found], 1) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"), lists(codes, pa.int32()),
                 lists(error, pa.int64())],
                ["vec_id", "label", "x", "codes", "errors"],
            )

    label = whole.schema["label"].dataType.simpleString()
    return whole.select("vec_id", "label", "x", "codes").mapInArrow(
        assign, f"vec_id long, label {label}, x array<int>, codes array<int>, errors array<long>"
    )


def _moved(assigned: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries (parts x entries x width) after an update, and bounds of their radii."""
    parts, k, width = entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        far = np.zeros((parts, k), np.int64)
        for batch in batches:
            x, codes, error = _padded(batch, parts, width), matrix(batch, "codes"), matrix(batch, "errors")
            for p in range(parts):
                more = summed(x[:, p], codes[:, p], k)
                total[p], count[p] = total[p] + more[0], count[p] + more[1]
                np.maximum.at(far[p], codes[:, p], error[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
             pa.array(far[part, entry], pa.int64()), lists(total[part, entry], pa.int64())],
            ["part", "entry", "n", "far", "total"],
        )

    rows = (
        assigned.select("x", "codes", "errors")
        .mapInArrow(partial, "part int, entry int, n long, far long, total array<long>")
        .select("part", "entry", "n", "far", F.posexplode_outer("total").alias("place", "sum"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
        .collect()
    )
    after, far = entries.copy(), np.zeros((parts, k))
    for r in rows:
        if r["place"] is not None:
            after[r["part"], r["entry"], r["place"]] = int(r["sum"]) // r["n"]
        far[r["part"], r["entry"]] = r["far"]
    way = np.sqrt(((after - entries) ** 2).sum(2).astype(float))
    return after, np.sqrt(far) + way


def ball_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Code and error of every vector of ``vectors (vec_id, embedding, label)``.

    Vectors that are null or hold null or non-finite components are dropped; components
    become ``floor(scale * x)``. Vectors are cut into ``parts`` equal parts; shorter
    ones count as padded with zeros to the longest kept one, and that to a multiple of
    ``parts``. Codebooks start as the parts of the ``entries`` (at most 256) smallest
    ids; of vectors that repeat an id those with smaller components come first, and
    those without an id come last. Equal distances go to the lower entry, unused entries
    stay. One row comes out for each kept row; rows with equal labels, or all without
    one, share ``label_error``. Empty tables give no rows. Other columns are ignored,
    whatever their names. A component beyond 2^23 after scaling raises an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    vector_batches(spark)
    scratch = Scratch(spark)
    whole = whole_numbers(vectors, scale, "label").withColumn("codes", F.array_repeat(F.lit(0), parts))
    whole = scratch.write(whole, "code-vectors")
    longest = whole.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        scratch.drop(whole)
        return spark.createDataFrame([], RESULT)
    width = -(-longest // parts)
    first = whole.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for row, r in zip(start, first, strict=True):
        row[: len(r["x"])] = r["x"]
    books = start.reshape(-1, parts, width).swapaxes(0, 1)
    radius: list = [None] * parts
    for _ in range(rounds):
        balls = [Balls(b, r) for b, r in zip(books, radius, strict=True)]
        after = scratch.write(_assigned(whole, balls, parts, width), "code-round")
        scratch.drop(whole)
        whole = after
        books, radius = _moved(whole, books)
    balls = [Balls(b, r) for b, r in zip(books, radius, strict=True)]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    done = _assigned(whole, balls, parts, width).select(
        "vec_id", "label", "codes", F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")
    )
    done = scratch.write(done, "code-done")
    scratch.drop(whole)
    by_label = scratch.write(done.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")), "code-labels")
    known = by_label.count()
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return done.join(
        F.broadcast(by_label) if known <= MAX_BROADCAST_ROWS else by_label, F.col("label").eqNullSafe(F.col("_of"))
    ).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
