"""Token ids of whole texts in Parquet files, and reading them back.

Files are in ascending order of ``doc_id``, sorted inside, one shard a range. Token ids
are a list column, dictionary-encoded with delta encoding where a dictionary grows too
large; row groups and pages have set sizes and page indexes, so that a reader of a few
documents, or of the metadata columns alone, touches only their pages.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinneret.llm.common import bounded_batches, slices, text_of
from spinneret.session import fresh_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
FILE_SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"

# Words whose ids a Python worker remembers, and their length, about 120 MB at most;
# others are encoded again.
_REMEMBERED, _LONGEST = 400_000, 48
# Words that show whether a vocabulary takes letters and the marks after them apart.
_PROBES = (
    *(("thereof", ","), ("Nation", "."), ("WORD", "!!"), ("sevenfold", "?"), ("a", "..."), ("and", ".***"), ("The", "&&&")),
    *(("ÉTÉ", ";"), ("Ñandú", "."), ("straße", ")]"), ("Œuvre", "|>"), ("ŽLUŤOUČKÝ", '"'), ("ſaiſon", "~")),
)
# ASCII marks but the apostrophe, which letters after it may belong to.
_MARKS = "".join(x for x in map(chr, range(33, 127)) if not x.isalnum() and x != "'")
# Letters of a Latin word that stay single letters without case, whatever stands beside them.
_LATIN = [chr(x) for x in (*range(0xC0, 0x180),) if x not in (0xD7, 0xF7, 0x130)]
_LETTERS = re.compile(f"[A-Za-z{''.join(_LATIN)}]+")


def _byte_letters() -> dict[int, str]:
    """For Latin letters what byte-level vocabularies have for their bytes: Latin-1's printing
    characters for themselves, and others in order from 256 on for the rest."""
    plain = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in plain)}
    return {ord(x): "".join(rest.get(b) or chr(b) for b in x.encode()) for x in _LATIN}


_BYTES = _byte_letters()


class _Encoder(dict):
    """The ids of words as bytes, remembered for the first words that a worker meets.

    A word is a run between spaces: no token spans white space, so a text's ids are those
    of its words. Where the vocabulary also takes letters and the punctuation after them
    apart and ignores case, the letters of a Latin word are looked up without either.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.plain = all(
            self._ids(core + tail) == self._ids(core) + self._ids(tail) == self._bare(core.lower()) + self._ids(tail)
            for core, tail in _PROBES
        )

    def _ids(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _bare(self, letters: str) -> bytes:
        """Ids of lower-case Latin letters, of which all steps before the merges only take the bytes."""
        if not letters.isascii():
            letters = letters.translate(_BYTES)
        return _packed([x.id for x in self.model.tokenize(letters)])

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        # Other letters may become several when their case goes, marks among them.
        if not (self.plain and _LETTERS.fullmatch(core)):
            ids = self._ids(word)
        elif len(core) < len(word):
            ids = self[core] + self[word[len(core) :]]
        elif word.islower():
            ids = self._bare(word)
        else:
            ids = self[word.lower()]
        if len(self) < _REMEMBERED and len(word) <= _LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        split = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, split))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


# Workers serve many tasks; each keeps the encoder of the vocabulary it used last.
_kept: dict[int, _Encoder] = {}


def _encoder(vocabulary: str) -> _Encoder:
    key = hash(vocabulary)
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Encoder(vocabulary)
    return _kept[key]


def _lists(codes: list[bytes]) -> pa.Array:
    lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    values = pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32())
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode the whole text of every row of ``docs`` and write ``FILE_SCHEMA`` to ``path``.

    ``vocabulary`` is the tokenizer's file as text. Each document's ids end with
    ``end_id``; null and empty texts have that id alone. Rows are ordered by id, null
    first, then by text, so repeated rows stand together. Other columns of ``docs`` are
    ignored, whatever their names. An empty table leaves files without rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, start, shard = _encoder(shared.value), 0, TaskContext.get().partitionId()
        for batch in slices(batches, 256):
            codes = [encoder.encode(x or "") + end for x in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.full(len(codes), shard, np.int32)),
                    pa.array(starts),
                    pa.array(sizes),
                    _lists(codes),
                ],
                ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
            )

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as written; select the columns and ids that are needed."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """``shard, shard_start``: ids in all shards before; reads the metadata columns only."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("shard_start"))


def token_index(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is the unsigned
    crc32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    bounded_batches(files.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "shard", "start_in_shard", "n_tokens")), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"],
            )

    read = files.mapInArrow(sums, "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(files), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and index what they hold.

    ``tokenizer`` is the path of a vocabulary file on the driver.
    """
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = file.read()
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return token_index(read_tokens(docs.sparkSession, path))
