"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line gets binary features from the characters and words of the line itself and of
its two neighbours. A two-state chain labels every line good or bad; forward-backward
gives the probability of good for each line, and a document's score is their mean,
weighted by the lengths of the lines. In training all lines carry their document's
label, from a bounded sample of the labelled rows; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spinneret.llm.common import bounded_batches, slices, text_of, texts

# Labelled documents that the model is fitted on, at most; those of the lowest hashes.
SAMPLE = 3_000
THRESHOLD = 0.3
HELD_OUT_OF = 5

# Character classes by byte: upper, lower, digit, space, ending marks, other marks.
_CLASSES = 7
_CLASS = np.full(256, 6, np.uint8)
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 0
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_CLASS[128:] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 3
_CLASS[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
_CLASS[np.frombuffer(b"!", np.uint8)] = 5

# Bounds of the bins of each measure of a line, the same for every input.
_BINS = (
    (0.02, 0.06, 0.15, 0.35, 0.7),  # upper-case share of the letters
    (0.01, 0.05, 0.15, 0.4),  # digits
    (0.01, 0.03, 0.06, 0.12, 0.25),  # ending marks
    (0.005, 0.02, 0.06, 0.15),  # exclamation marks
    (0.004, 0.012, 0.03, 0.08, 0.16, 0.3),  # other marks
    (2.5, 3.5, 4.5, 5.5, 7.0, 10.0, 20.0),  # characters a word
    (1, 20, 60, 120, 250, 500, 1000, 4000),  # length
    (0.3, 0.5, 0.65, 0.8, 0.95),  # share of different words
    (0.5,),  # equal to an earlier line
)
_WIDTHS = [len(x) + 1 for x in _BINS]
_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS)))
#: Features of one line; a line's own, the previous one's and the next one's follow each other.
LINE_FEATURES = int(_STARTS[-1]) + 1
_EDGE = LINE_FEATURES - 1
FEATURES = 3 * LINE_FEATURES


def line_features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of all texts: feature numbers, lengths, and where each text starts.

    A text without any line has one empty line.
    """
    lines: list[bytes] = []
    starts = np.empty(len(found) + 1, np.int64)
    distinct, repeated = [], []
    for i, text in enumerate(found):
        starts[i] = len(lines)
        own = text.split(b"\n")
        lines += own
        earlier: set[bytes] = set()
        for line in own:
            n = line.split()
            distinct.append(len(set(n)) / len(n) if n else 1.0)
            repeated.append(line in earlier)
            earlier.add(line)
    starts[-1] = len(lines)
    joined = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    kind = _CLASS[joined]
    ends = np.flatnonzero(joined == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    counts = np.stack([np.add.reduceat(kind == c, begins, dtype=np.int64) for c in range(_CLASSES)])
    length = ends - begins
    visible = np.maximum(length + 1 - counts[3], 1)
    word = (kind != 3) & np.concatenate(([True], kind[:-1] == 3))
    n_words = np.add.reduceat(word, begins, dtype=np.int64)
    measures = (
        counts[0] / np.maximum(counts[0] + counts[1], 1),
        counts[2] / visible,
        counts[4] / visible,
        counts[5] / visible,
        counts[6] / visible,
        visible / np.maximum(n_words, 1),
        length,
        np.array(distinct),
        np.array(repeated, float),
    )
    own = np.stack(
        [np.searchsorted(bins, x, side="right") + s for bins, x, s in zip(_BINS, measures, _STARTS, strict=False)], 1
    )
    edge = np.full((1, own.shape[1]), _EDGE)
    before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    before[starts[:-1]] = _EDGE
    after[starts[1:] - 1] = _EDGE
    return np.concatenate((own, before + LINE_FEATURES, after + 2 * LINE_FEATURES), 1), length, starts


def _marginals(emit: np.ndarray, step: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts side by side.

    ``emit`` is the log weight of good against bad for each line, ``step`` the 2 x 2 log
    weights of neighbouring states. Gives the probability of good for each line, the
    expected counts of the four steps, and the sum of the log partition functions.
    """
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(1, size.max(initial=1) + 1), side="right")
    first = starts[:-1][order]
    move = np.exp(step)
    weight = np.stack((np.ones_like(emit), np.exp(np.clip(emit, -30, 30))), 1)
    forward, scale = np.empty_like(weight), np.empty(len(emit))
    state = None
    for t, n in enumerate(active):
        at = first[:n] + t
        state = weight[at] if t == 0 else (state[:n] @ move) * weight[at]
        scale[at] = state.sum(1)
        state = state / scale[at][:, None]
        forward[at] = state
    good = np.empty(len(emit))
    steps = np.zeros((2, 2))
    back = np.ones((len(size), 2))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        on = active[t + 1] if t + 1 < len(active) else 0
        if on:
            later = first[:on] + t + 1
            push = weight[later] * back[:on] / scale[later][:, None]
            steps += move * (forward[at[:on]].T @ push)
            back[:on] = push @ move.T
        both = forward[at] * back[:n]
        good[at] = both[:, 1] / both.sum(1)
    return good, steps, float(np.log(scale).sum())


def fit(features: list[np.ndarray], labels: list[int], rounds: int = 300, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the steps, by Adam on the penalised log-likelihood."""
    if not labels:
        return np.zeros(FEATURES), np.zeros((2, 2))
    x = np.concatenate(features)
    starts = np.concatenate(([0], np.cumsum([len(f) for f in features])))
    y = np.repeat(np.array(labels, float), np.diff(starts))
    inner = np.ones(len(y), bool)
    inner[starts[:-1]] = False
    seen = np.array([[np.sum(inner & (y == b) & (np.roll(y, 1) == a)) for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        good, steps, _ = _marginals(w[x].sum(1), step, starts)
        slope = np.bincount(x.ravel(), np.repeat(y - good, x.shape[1]), FEATURES)
        slope = np.concatenate((slope, (seen - steps).ravel())) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``sample`` labelled documents, held-out ones left out.

    Of ids labelled more than once the larger label holds; rows without id or label are
    left out. Without any labelled document all weights are 0 and all scores a half.
    Only the sample's line features reach the driver.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .where("_id IS NOT NULL AND _label IS NOT NULL")
        .where(~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    chosen = docs.select(F.col("doc_id").alias("_id"), text_of("text").alias("text")).join(F.broadcast(known), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            if batch.num_rows:
                rows, _, starts = line_features(texts(batch))
                parts = [rows[a:b].astype(np.int16).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(parts, pa.binary()), batch.column("_label")], ["id", "rows", "label"]
                )

    found = chosen.select("_id", "text", "_label").mapInArrow(features, "id long, rows binary, label int").collect()
    # An order that does not depend on the partitions, so that reruns agree.
    found.sort(key=lambda r: (r["id"], r["label"], bytes(r["rows"])))
    width = 3 * len(_BINS)
    rows = [np.frombuffer(bytes(r["rows"]), np.int16).reshape(-1, width).astype(np.int64) for r in found]
    return fit(rows, [int(r["label"] > 0) for r in found])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0


def with_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "_score") -> DataFrame:
    """``docs`` with all its columns and ``column``, the score of the whole text.

    Null texts count as empty; an empty text is one empty line. Equal texts get equal
    scores, whatever else their rows hold. ``column`` must be a new name.
    """
    bounded_batches(docs.sparkSession)
    weights, step = model
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            rows, length, starts = line_features(texts(batch))
            good, _, _ = _marginals(weights[rows].sum(1), step, starts)
            share = np.maximum(length, 1)
            means = np.add.reduceat(good * share, starts[:-1]) / np.add.reduceat(share, starts[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(means, 0, 1))], [*names, column])

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(score, schema)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null id is not held out. Only the text enters the score.
    """
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
