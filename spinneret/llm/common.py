"""What the operators share: the words of a text, bounded batches, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.session import fresh_path

# Words are runs of other characters than space and \t to \r. Python's
# bytes.split() without arguments splits at the same six characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

# Words that a task remembers the hash of, and their length; 60 MB at most.
_REMEMBERED, _LONGEST = 300_000, 64
# Bytes of texts that a task works on together, and that go to it in one batch.
_SLICE, _BATCH = 1 << 20, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, by rows and by bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH))


def text_of(column: str | Column) -> Column:
    """The text, empty where there is none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        found = self.hashed(word)
        if len(word) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = found
        return found

    @staticmethod
    def hashed(word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column of a batch as bytes, empty where there is none."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of at most ``rows`` rows and, unless it is one row, ``size`` bytes of text."""
    for batch in batches:
        upto = np.cumsum(_text_bytes(batch))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def _text_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's strings and binary values."""
    found = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if any(f(column.type) for f in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
            found += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return found


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the columns named on the left, under the names on the right."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


class Scratch:
    """Tables in the shared folder, each deleted as soon as its readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned; nothing may read them any more."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
