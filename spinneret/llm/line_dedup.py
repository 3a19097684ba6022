"""Line dedup by content-defined chunks of lines and by windows of 50 words.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so the
same passage is cut alike wherever it stands in a text. Chunks of several lines that
occur more than once, in one document or in many, are removed but for their first
occurrence.

Chunks depend on the line before a passage, so they miss parts of short ones. Of each
line, the shortest run of lines with 50 words that starts with it and the shortest that
ends with it are treated like chunks as well. Any repeated run of 50 words or more is
made of such windows, whatever stands around it, so all of it is found.

The first pass shuffles digests only. Those that repeat set bits in a filter of fixed
size, so that the second pass carries only what may repeat, with its bytes, which are
compared. The digest goes first, so that few of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinneret.llm.common import bounded_batches, mixed, slices, text_of, texts
from spinneret.session import written

# Lines that the rolling hash looks back on, and one line in how many ends a chunk.
WINDOW, ONE_IN = 2, 2
# A chunk has this many lines with words and as many words; a line of many words counts alone.
MIN_LINES, MIN_WORDS, LONG_WORDS = 2, 10, 50
# Bits of the filter: 8 MB, whatever the data.
FILTER_BITS = 26
# Bytes of chunks that a task holds before it hands them on.
_CARRIED = 8 << 20


def chunk_ends(lines: list[bytes], window: int = WINDOW, one_in: int = ONE_IN) -> list[int]:
    """Where each chunk ends: the number of the line after it; the last is all lines.

    A chunk has at least ``MIN_LINES`` lines, unless the text ends or its only line has
    ``LONG_WORDS`` words.
    """
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolled = hashes.copy()
    for back in range(1, window):
        if back < len(lines):
            rolled[back:] = mixed(rolled[back:] ^ mixed(hashes[:-back] + np.uint64(back)))
    cut = (mixed(rolled) % np.uint64(one_in) == 0).tolist()
    ends, start = [], 0
    for i, here in enumerate(cut):
        long_ = len(lines[i]) >= 2 * LONG_WORDS and len(lines[i].split()) >= LONG_WORDS
        # A long line is a passage of its own: it neither waits for others nor joins them.
        if long_ and i > start:
            ends.append(i)
            start = i
        if long_ or (here and i + 1 - start >= MIN_LINES):
            ends.append(i + 1)
            start = i + 1
    if start < len(lines):
        ends.append(len(lines))
    return ends


def _windows(words: list[int]) -> Iterator[tuple[int, int]]:
    """For each line with words, the shortest runs of ``LONG_WORDS`` words that start and end with it."""
    end = total = 0
    for begin, n in enumerate(words):
        while total < LONG_WORDS and end < len(words):
            total += words[end]
            end += 1
        if total < LONG_WORDS:
            break
        if n:
            yield begin, end
        total -= n
    begin = total = 0
    for end, n in enumerate(words, 1):
        total += n
        while total - words[begin] >= LONG_WORDS:
            total -= words[begin]
            begin += 1
        if n and total >= LONG_WORDS:
            yield begin, end


def _chunks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """First line, line after the last, and bytes of each chunk or window that can be removed."""
    lines = text.split(b"\n")
    words = [len(x.split()) for x in lines]
    found, start = set(_windows(words)), 0
    for end in chunk_ends(lines):
        total = sum(words[start:end])
        if total >= MIN_WORDS and sum(n > 0 for n in words[start:end]) >= MIN_LINES:
            found.add((start, end))
        start = end
    at = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
    for begin, end in sorted(found):
        yield begin, end, text[at[begin] : at[end] - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and a hash of their text, as rows may repeat an id."""
    text = text_of("text")
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))


def _filter(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit for each digest, in a table of ``2 ** bits`` that is all the driver sees."""
    place = F.col("digest").bitwiseAND(F.lit((1 << bits) - 1))
    words = repeated.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(
            F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        ).alias("bits")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, found in words.toLocalIterator():
        out[word] = found
    return out.view(np.uint64)


def removable(docs: DataFrame, bits: int = FILTER_BITS, digest_bits: int = 64) -> DataFrame:
    """``_id, _th, begin, end``: runs of lines to remove, no two of a text overlap or touch.

    Digests of fewer bits give the same rows, with more bytes to tell chunks apart by.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = _keyed(docs)
    whole = (1 << digest_bits) - 1

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [xxhash.xxh3_64_intdigest(c) & whole for x in texts(batch) for _, _, c in _chunks(x)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["digest"])

    counted = keyed.select("text").mapInArrow(digests, "digest long").groupBy("digest").count()
    shared = spark.sparkContext.broadcast(_filter(counted.where("count > 1"), bits))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "_th", "begin", "end", "digest", "content"]
        )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = shared.value, (1 << bits) - 1
        for batch in slices(batches, 256):
            rows, size = [], 0
            ids, hashes = batch.column("_id").to_pylist(), batch.column("_th").to_pylist()
            for i, text in enumerate(texts(batch)):
                for begin, end, content in _chunks(text):
                    digest = xxhash.xxh3_64_intdigest(content) & whole
                    place = digest & mask
                    if int(table[place >> 6]) >> (place & 63) & 1:
                        rows.append((ids[i], hashes[i], begin, end, digest - (digest >> 63 << 64), content))
                        size += len(content)
                # Windows of a text overlap: their bytes go on in bounded batches.
                if size >= _CARRIED:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    found = written(
        keyed.withColumn("_id", F.col("_id").cast("long")).mapInArrow(
            chunks, "_id long, _th long, begin int, end int, digest long, content binary"
        ),
        "line-chunks",
    )

    def firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The first of the chunks that share ``keys``, and whether all of them are the same bytes."""
        found = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("c"),
            F.min(F.struct("_id", "_th", "begin", "end")).alias("first"),
            (F.min("content") == F.max("content")).alias("same"),
        )
        return written(found.where("c > 1").drop("c"), "line-first")

    # Bytes are compared within a digest, once; only where they differ do they tell chunks apart.
    keys = ["digest"]
    first = firsts(found, keys)
    differ = first.where("NOT same").select("digest", "same")
    if differ.limit(1).count():
        apart = F.when(F.col("same").isNotNull(), F.col("content")).otherwise(F.lit(b""))
        found = written(found.join(differ, "digest", "left").withColumn("content", apart).drop("same"), "line-apart")
        keys = ["digest", "content"]
        first = firsts(found, keys)
    first = first.drop("same")
    here = F.struct("_id", "_th").eqNullSafe(F.struct("first._id", "first._th"))
    later = (
        found.join(first, keys)
        .where(~(here & (F.col("begin") == F.col("first.begin"))))
        # The first occurrence stays whole where the next one overlaps it.
        .withColumn("begin", F.when(here, F.greatest("begin", "first.end")).otherwise(F.col("begin")))
        .select("_id", "_th", "begin", "end")
        .distinct()
    )
    lines = Window.partitionBy("_id", "_th").orderBy("begin", "end")
    reached = F.max("end").over(lines.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("begin") <= reached, 0).otherwise(1)
    return (
        later.withColumn("_apart", apart)
        .withColumn("_run", F.sum("_apart").over(lines.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_id", "_th", "_run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .drop("_run")
    )


def dedup_lines(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``docs``, all columns, with ``text`` less its repeated chunks and windows, and what was removed.

    Added are ``n_lines``, ``n_removed`` (lines) and ``removed``, runs of line numbers
    ``begin:end`` from 0, end exclusive, comma-joined. Of equal chunks the one in the
    row with the smallest id (null first), then the smallest hash of its text, then the
    earliest in it, stays, but for what repeats an even earlier one: every line that is
    removed stays in an earlier place. Rows equal in id and text are treated alike. A null text
    stays null and has one empty line, an empty one too. Columns that have the names
    added are an error; others may have any name.
    """
    gone = removable(docs, bits).groupBy("_id", "_th").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("_runs")
    )
    taken = sorted({"n_lines", "n_removed", "removed"}.intersection(docs.columns))
    if taken:
        raise ValueError(f"columns of these names are added: {', '.join(taken)}")
    text = text_of("`text`")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("`doc_id`").cast("long").alias("id"), F.xxhash64(text).alias("th"),
        F.split(text, "\n", -1).alias("lines"),
    )
    both = rows.join(gone, rows["id"].eqNullSafe(gone["_id"]) & (rows["th"] == gone["_th"]), "left")
    runs = F.col("_runs")
    # Runs are in order and apart: what stays are the slices between them.
    between = F.transform(
        F.sequence(F.lit(0), F.size(runs)),
        lambda i: F.slice(
            F.col("lines"),
            F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get(runs, i)["begin"], F.size("lines")) - F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)),
        ),
    )
    left = F.when(runs.isNull(), F.col("row")["text"]).otherwise(F.array_join(F.flatten(between), "\n"))
    removed = F.aggregate(runs, F.lit(0), lambda n, r: n + r["end"] - r["begin"])
    spans = F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["begin"], r["end"])), ",")
    return both.select(
        *[left.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.lit("")).alias("removed"),
    )
