"""Benchmark decontamination by latent semantic retrieval, confirmed word by word.

Documents and benchmark items are cut into passages of 32 words. Words are hashed once,
to 32 bits, and the rest works on these numbers: their upper half names one of a fixed
number of features, and all of them tell words apart. Features are weighted by TF-IDF with counts over all passages of all
documents. A randomised SVD (subspace iteration; each pass sums A'(A X) over all passages
of all documents and of the benchmark) gives a latent space, in which every passage
of every document is compared by cosine with every passage of the benchmark, the stated
query set, block by block. A candidate is a leak if the longest common subsequence of
words covers most of the item; if it covers a good part, as in a paraphrase, the item's
answer must stand there too.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import WordHashes, bounded_batches, mixed, slices, text_of
from spinneret.operators.joins import MAX_BROADCAST_ROWS
from spinneret.session import written, written_counted

FEATURE_BITS = 16
# Words to half a passage; passages overlap by half.
HALF = 16
RANK, EXTRA, PASSES = 160, 8, 3
# All passages of documents weigh in the fit together as this many at most, and so do the
# benchmark's own, each of which weighs more, so that items stay apart in the space.
WEIGHED, ASKED_WEIGHT = 8_192, 4.0
# Passages that make a task of the fit worth its sum, of 44 MB.
FIT_PASSAGES = 1 << 19
# Sums of rows made side by side, and rows held to be summed.
_BESIDE, _HELD = 256, 512
# Benchmark items held at a time.
BLOCK = 2_000
COSINE = 0.6
# Shares of an item's words in common, in order: a copy; a paraphrase if its answer is there.
COPY, PARAPHRASE = 0.75, 0.6
# Without an answer of its own, an item's rarest words stand for it.
ANSWER_WORDS, ANSWER_SHARE = 8, 0.75
_FEATURES = 1 << FEATURE_BITS
# What a byte adds to a word's number: nothing for ASCII characters that are neither letters
# nor digits, the same for both cases of a letter, and more the further on it stands.
_CODES = mixed(np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint64) + np.uint64(1))
_CODES[[b for b in range(128) if not chr(b).isalnum()]] = 0
_STEP = 0x9E3779B97F4A7C15
# Bytes of words that are numbered together, few enough to stay in a cache.
_TOGETHER = 1 << 16
# Features that a row of a sum holds, so that no row is large.
_ROWS = 1024


def _numbers(words: pa.StringArray) -> np.ndarray:
    """A 32-bit number for each word, without case and marks of ASCII; 0 if nothing is left."""
    if not len(words):
        return np.zeros(0, np.uint32)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    code = _CODES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint64)
    ends -= ends[0]
    before = np.concatenate(([0], np.cumsum(code != 0)))
    place = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
    # Powers of an odd number; all of this counts modulo 2 ** 64.
    powers = np.full(place.max(initial=0) + 1, _STEP, np.uint64)
    powers[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * np.cumprod(powers)[place])))
    found = mixed(sums[ends[1:]] - sums[ends[:-1]]) >> np.uint64(32)
    return np.where(before[ends[1:]] == before[ends[:-1]], 0, np.maximum(found, 1)).astype(np.uint32)


def _powers(of: int, n: int) -> np.ndarray:
    powers = np.full(n, of, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _plain(character: str) -> str:
    return "".join(filter(str.isalnum, character.casefold()))


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """For each character of two bytes, what its bytes add to a word's number, and whether
    that says all: what stands for it without case may be longer."""
    plain = [_plain(chr(c)).encode() if c >= 128 else b"" for c in range(2048)]
    short = np.array([len(x) <= 2 for x in plain])
    codes = np.zeros((2048, 2), np.uint64)
    for c in np.flatnonzero(short).tolist():
        codes[c, : len(plain[c])] = _CODES[list(plain[c])]
    return codes, short


_PAIRS, _SHORT = _pairs()
_UP, _DOWN = _powers(_STEP, _TOGETHER), _powers(pow(_STEP, -1, 1 << 64), _TOGETHER)


def _quick_numbers(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The ``_numbers`` of words as they are without case and marks, and which words these
    are not right for: those with other characters than of one or two bytes."""
    numbers, odd = np.zeros(len(words), np.uint32), np.zeros(len(words), bool)
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return numbers, odd
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(words):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _TOGETHER, "right")) - 1)
        some, here = data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]
        code = np.take(_CODES, some)
        high = np.flatnonzero(some >= 128)
        if len(high):
            value, begins = some[high], np.zeros(len(some) + 1, bool)
            begins[here[:-1]] = True
            # A byte that begins a character of two, and the one after it, in the same word.
            pair = np.zeros(len(high) + 1, bool)
            pair[1:-1] = (value[:-1] >= 0xC2) & (value[:-1] < 0xE0) & (value[1:] < 0xC0)
            pair[1:-1] &= (np.diff(high) == 1) & ~begins[high[1:]]
            first = np.flatnonzero(pair[1:])
            character = (value[first].astype(np.int64) & 31) << 6 | value[first + 1] & 63
            code[high[first]], code[high[first] + 1] = _PAIRS[character].T
            bad = np.concatenate((high[~(pair[1:] | pair[:-1])], high[first[~_SHORT[character]]]))
            odd[at + np.searchsorted(here, bad, "right") - 1] = True
        kept = code != 0
        rank = np.concatenate((np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)))[here]
        code = code[kept]
        # By powers that count on from word to word, and back by those of each word's begin;
        # a word that is longer than they reach is alone, and one that begins there is empty.
        up = _UP if len(code) <= _TOGETHER else _powers(_STEP, len(code))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * up[: len(code)])))
        begin, end = rank[:-1], rank[1:]
        found = mixed((sums[end] - sums[begin]) * _DOWN[np.minimum(begin, _TOGETHER - 1)]) >> np.uint64(32)
        numbers[at:upto] = np.where(begin == end, 0, np.maximum(found, 1))
        at = upto
    return numbers, odd


class _Words(WordHashes):
    """Numbers of words without case and punctuation; 0 for those that are nothing else.

    Remembered are words with other characters than ASCII, as they are without those.
    """

    @staticmethod
    def hashed(word: bytes) -> str:
        return _plain(word.decode("utf-8", "replace"))

    def of(self, found: pa.StringArray) -> np.ndarray:
        plain = pc.string_is_ascii(found).to_numpy(zero_copy_only=False)
        out = np.zeros(len(found), np.uint32)
        out[plain] = _numbers(found.filter(pa.array(plain)))
        odd = found.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
        out[~plain] = _numbers(pa.array(list(map(self.__getitem__, odd)), pa.string()))
        return out

    def all(self, text: bytes) -> np.ndarray:
        return self.each(pa.array([text], pa.binary()).cast(pa.string()))[0]

    def each(self, column: pa.StringArray) -> list[np.ndarray]:
        """The words of each text as 32-bit numbers."""
        # Splits at the six characters that SPACE has, like bytes.split().
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        every = split.flatten()
        hashes, odd = _quick_numbers(every)
        if odd.any():
            rare = every.filter(pa.array(odd)).dictionary_encode()
            hashes[odd] = self.of(rare.dictionary)[rare.indices.to_numpy()]
        kept = hashes != 0
        ends = np.concatenate(([0], np.cumsum(kept)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        hashes = hashes[kept]
        return [hashes[a:b] for a, b in itertools.pairwise(ends)]


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)


def hashed_words(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, words``: the words of each row's text as numbers, and its digest."""
    bounded_batches(docs.sparkSession)
    text = text_of("`text`")
    read = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches, 512):
            found = pa.array([x.tobytes() for x in words.each(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), found], ["doc_id", "mark", "words"])

    return read.mapInArrow(hashed, "doc_id long, mark binary, words binary")


def _words_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in batch.column("words").to_pylist()]


def _passages(n: int, step: int) -> list[tuple[int, int]]:
    """Where the passages of a text of ``n`` words begin and end, ``step`` words apart."""
    width = 2 * HALF
    return [(a, min(a + width, n)) for a in range(0, max(n - width, 0) + step, step) if a < max(n, 1)] if n else []


def _grid(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts' words, ``width`` to a row, the last row of a text filled up with
    the feature of nothing; and how many rows each text has."""
    sizes = np.array([len(x) for x in texts])
    rows = -(-sizes // width)
    begin = np.repeat((np.cumsum(rows) - rows) * width - (np.cumsum(sizes) - sizes), sizes)
    grid = np.full(rows.sum() * width, _FEATURES)
    grid[np.arange(sizes.sum()) + begin] = _features(np.concatenate(texts))
    return grid.reshape(-1, width), rows


def passage_stats(hashed: DataFrame) -> DataFrame:
    """``feature, count``: in how many passages a feature occurs, a row for each task that
    met it; under the number behind the last feature, how many passages there are.
    """
    bounded_batches(hashed.sparkSession)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_FEATURES + 1, np.int64)
        for batch in slices(batches, 256):
            found = [x for x in _words_of(batch) if len(x)]
            if not found:
                continue
            every = np.concatenate(found)
            begins, at = [], 0
            for x in found:
                begins.append(np.arange(at, at + len(x), 2 * HALF))
                at += len(x)
            begins = np.concatenate(begins)
            # Passages as rows, short ones filled up with their first word; in order,
            # a feature counts where it differs from the one before.
            lengths = np.diff(np.append(begins, at))
            place = np.arange(2 * HALF)[None, :]
            grid = every[begins[:, None] + np.where(place < lengths[:, None], place, 0)]
            grid = np.sort((grid >> np.uint32(32 - FEATURE_BITS)).astype(np.uint16), axis=1)
            fresh = np.ones(grid.shape, bool)
            fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
            counts[:-1] += np.bincount(grid[fresh], minlength=_FEATURES)
            counts[-1] += len(begins)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["feature", "count"])

    return hashed.select("words").mapInArrow(stats, "feature long, count long")


def _passage_counts(stats: DataFrame) -> np.ndarray:
    counts = np.zeros(_FEATURES + 1)
    for row in stats.groupBy("feature").agg(F.sum("count").alias("n")).collect():
        counts[row["feature"]] = row["n"]
    return counts


def _lengths(grid: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The length of each row of the TF-IDF matrix, of passages given as a ``_grid``."""
    ordered = np.sort(grid.astype(np.int32), axis=1)
    fresh = np.ones(grid.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    cell = np.flatnonzero(fresh)
    feature, count = ordered.ravel()[cell], np.diff(cell, append=grid.size)
    weight = np.append(idf, 0.0)[feature]
    norm = np.sqrt(np.bincount(cell // grid.shape[1], (count * weight) ** 2, len(grid)))
    return np.maximum(norm, 1e-9)


def _weighted(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and weights of the TF-IDF matrix of passages, rows of length 1."""
    row = np.repeat(np.arange(len(passages)), [len(x) for x in passages])
    cell, count = np.unique(row * _FEATURES + _features(np.concatenate(passages)), return_counts=True)
    row, feature = cell // _FEATURES, cell % _FEATURES
    norm = np.sqrt(np.bincount(row, (count * idf[feature]) ** 2, len(passages)))
    return row, feature, (count * idf[feature] / np.maximum(norm, 1e-9)[row]).astype(np.float32)


def _row_sums(grid: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each row of ``grid`` the sum of the rows of ``source`` that it names, in order."""
    width = grid.shape[1]
    step, out = _HELD // width, np.empty((len(grid), source.shape[1]), np.float32)
    held = np.empty((step * width, source.shape[1]), np.float32)
    for at in range(0, len(grid), step):
        # What all rows name first, then what they name second, and so on, one below the other.
        some = grid[at : at + step].T
        rows = np.take(source, some.ravel(), axis=0, out=held[: some.size], mode="clip")
        np.add.reduce(rows.reshape(width, -1), axis=0, out=out[at : at + step].reshape(-1))
    return out


def _sums(group: np.ndarray, row: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups, in no order, and for each the sum of the rows of ``source`` that its
    entries name. Entries are ordered by group."""
    groups, sums = zip(*((some, part.copy()) for some, part in _some_sums(group, row, source)), strict=True)
    return np.concatenate(groups), np.concatenate(sums)


def _some_sums(group: np.ndarray, row: np.ndarray, source: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``_sums`` some groups at a time; those given hold only until the next are asked for."""
    begins = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    counts = np.diff(np.append(begins, len(group)))
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    groups = group[begins]
    # Groups that name many of the rows: as a matrix of how often they do, some at a time.
    many = int(np.searchsorted(-counts, -max(_BESIDE, len(source) // 16), "right"))
    for at in range(0, many, 64):
        size = counts[at : min(at + 64, many)]
        entry = np.repeat(begins[at : at + len(size)] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(np.arange(len(size)) * len(source), size) + row[entry]
        named = np.bincount(cell, minlength=len(size) * len(source)).astype(np.float32)
        yield groups[at : at + len(size)], named.reshape(len(size), -1) @ source
    # The first entries of some groups side by side, then the second of those that have one.
    held, out = np.empty((2, _BESIDE, source.shape[1]), np.float32)
    for at in range(many, len(begins), _BESIDE):
        first, size = begins[at : at + _BESIDE], counts[at : at + _BESIDE]
        sums = np.take(source, row[first], axis=0, out=out[: len(first)], mode="clip")
        for turn, n in enumerate(np.searchsorted(-size, -np.arange(1, size[0]), "left").tolist(), 1):
            sums[:n] += np.take(source, row[first[:n] + turn], axis=0, out=held[:n], mode="clip")
        yield groups[at : at + _BESIDE], sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of features: the sum of its parts, in double precision, so that their order does not show."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, rows, part in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "part")), strict=True):
            rows = np.frombuffer(rows, np.int64)
            part = np.frombuffer(part, np.float32).reshape(len(rows), -1)
            if block not in blocks:
                blocks[block] = np.zeros((_ROWS, part.shape[1]))
            blocks[block][rows] += part
    every = np.arange(_ROWS).tobytes()
    for block, total in blocks.items():
        yield pa.RecordBatch.from_pydict({"block": [block], "rows": [every], "part": [total.astype(np.float32).tobytes()]})


def latent_space(texts: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, passes: int = PASSES) -> np.ndarray:
    """A features x rank matrix, the leading right singular vectors of all passages of
    ``texts``, and below it a row of zeros, for a feature of nothing.

    ``texts`` has ``words``, the word hashes of a text, and the ``weight`` of each of its
    passages. Each pass is a Spark job over all of them: a task has its part of A'(A X)
    for the features it met, parts are added up by blocks of features, and the driver
    takes the sum, of fixed size, block by block. The last pass only needs the columns'
    products (A X)'(A X). The driver holds two matrices of that size, and makes columns
    orthonormal by their small matrix of products.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    width = rank + extra
    # Each feature begins in one column alone, so columns are orthogonal, and the first
    # A X is a sum of few numbers.
    pick = np.random.default_rng(0)
    column, sign = pick.integers(0, width, _FEATURES), pick.choice([-1.0, 1.0], _FEATURES)
    sign /= np.sqrt(np.bincount(column, minlength=width))[column]
    basis = np.zeros((_FEATURES, width), np.float32)
    basis[np.arange(_FEATURES), column] = sign
    idf_ = spark.sparkContext.broadcast(idf)
    own = idf.astype(np.float32)[:, None]
    schema = "block long, rows binary, part binary"
    for turn in range(passes):
        # A row of A is a passage's words, each by its IDF, by the passage's length; the
        # former is put into X before and into the sum after, the latter into A X.
        # Below either stands a row for the feature of nothing.
        if turn:
            start = np.zeros((_FEATURES + 1, width), np.float32)
            np.multiply(basis, own, out=start[:-1])
        else:
            start = np.append(column, 0), np.append(sign * idf, 0.0)
        shared = spark.sparkContext.broadcast(start)
        last = turn == passes - 1

        def part(batches: Iterator[pa.RecordBatch], shared=shared, first=not turn, last=last) -> Iterator[pa.RecordBatch]:
            out = np.zeros((width if last else _FEATURES, width), np.float32)
            for batch in slices(batches, 512):
                found = _words_of(batch)
                if not any(map(len, found)):
                    continue
                grid, rows = _grid(found, 2 * HALF)
                weight = np.repeat(batch.column("weight").to_numpy(), rows)
                norm = _lengths(grid, idf_.value)
                if first:
                    column, sign = shared.value
                    seen = np.bincount(
                        (np.arange(len(grid))[:, None] * width + column[grid]).ravel(), sign[grid].ravel(), len(grid) * width
                    )
                    seen = seen.astype(np.float32).reshape(-1, width)
                else:
                    seen = _row_sums(grid, shared.value)
                scale = (weight / norm).astype(np.float32)[:, None]
                seen *= scale
                if last:
                    out += seen.T @ seen
                else:
                    seen *= scale
                    place = np.flatnonzero(grid != _FEATURES)
                    feature = grid.ravel()[place].astype(np.uint16)
                    order = np.argsort(feature, kind="stable")
                    for group, sums in _some_sums(feature[order], place[order] // grid.shape[1], seen):
                        out[group] += sums
            rows = np.flatnonzero(out.any(1))
            for block in np.unique(rows // _ROWS).tolist():
                some = rows[rows // _ROWS == block]
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "rows": [(some % _ROWS).tobytes()], "part": [out[some].tobytes()]}
                )

        parts = texts.select("words", "weight").mapInArrow(part, schema)
        total = np.zeros((width if last else _FEATURES, width), np.float32)
        for x in parts.repartition("block").mapInArrow(_added, schema).toLocalIterator():
            at = x["block"] * _ROWS
            some = np.frombuffer(x["part"], np.float32).reshape(-1, width)
            total[at : at + _ROWS] += some[: len(total) - at]
        if last:
            # basis' A'A basis is small: its eigenvectors turn the basis into singular vectors.
            _, turnings = np.linalg.eigh(total.astype(np.float64))
            turned = np.zeros((_FEATURES + 1, rank), np.float32)
            np.matmul(basis, turnings[:, ::-1][:, :rank].astype(np.float32), out=turned[:-1])
            basis = turned
        else:
            basis = np.multiply(total, own, out=total)
            _orthonormal(basis)
        shared.destroy()
    idf_.destroy()
    return basis


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The columns of ``a`` times those of ``b``, in double precision, by blocks of rows."""
    out = np.zeros((a.shape[1], b.shape[1]))
    for at in range(0, len(a), _ROWS):
        out += a[at : at + _ROWS].T.astype(np.float64) @ b[at : at + _ROWS].astype(np.float64)
    return out


def _orthonormal(columns: np.ndarray) -> None:
    """Replace the columns by orthonormal ones that span the same space."""
    size, turnings = np.linalg.eigh(_products(columns, columns))
    # What is nearly a sum of other columns stays out, as columns of next to nothing.
    turned = (turnings / np.sqrt(np.maximum(size, size[-1] * 1e-10 + 1e-30))).astype(np.float32)
    for at in range(0, len(columns), _ROWS):
        columns[at : at + _ROWS] = columns[at : at + _ROWS] @ turned


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def common_share(masks: dict[int, int], n: int, region: list[int]) -> float:
    """The longest common subsequence of an item and a region, as a share of the item.

    ``masks`` has, for each word of the item, the places where it stands as bits; the
    table's rows are kept as the bits of one number.
    """
    full = (1 << n) - 1
    state = full
    for word in region:
        if mask := masks.get(word):
            hit = state & mask
            state = (state + hit | state - hit) & full
    return (n - state.bit_count()) / n


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[int, ...]
    masks: dict
    answer: frozenset
    answer_given: bool


def _items(rows: list, idf: np.ndarray) -> list[Item]:
    words = _Words()
    out = []
    for item_id, text, answer in rows:
        found = words.all((text or "").encode())
        if not len(found):
            continue
        masks: dict[int, int] = {}
        for i, w in enumerate(found.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        given = words.all((answer or "").encode()).tolist()
        rarest = sorted(set(found.tolist()), key=lambda w: (-idf[w >> (32 - FEATURE_BITS)], w))[:ANSWER_WORDS]
        out.append(Item(item_id, tuple(found.tolist()), masks, frozenset(given or rarest), bool(given)))
    return out


def _leaks(items: list[Item], space: np.ndarray, cosine: float):
    """A function from the words of texts to (row, item, cosine, share) of the leaks in them."""
    spans = [(i, a, b) for i, item in enumerate(items) for a, b in _passages(len(item.words), HALF // 2)]
    of = np.array([i for i, _, _ in spans], np.int64)
    asked = _unit(
        np.stack([space[_features(np.array(items[i].words[a:b], np.uint32))].sum(0) for i, a, b in spans])
    ).astype(np.float32)

    def judge(region: list[int], item: Item) -> tuple[float, bool]:
        share = common_share(item.masks, len(item.words), region)
        if share >= COPY or share < PARAPHRASE:
            return share, share >= COPY
        there = len(item.answer.intersection(region)) / len(item.answer)
        return share, there >= (1.0 if item.answer_given else ANSWER_SHARE)

    def search(hashes: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        kept = [i for i, x in enumerate(hashes) if len(x)]
        if not kept:
            return []
        halved, lengths = _grid([hashes[i] for i in kept], HALF)
        # Half passages side by side, and one of nothing.
        halves = np.zeros((len(halved) + 1, space.shape[1]), np.float32)
        halves[:-1] = _row_sums(halved, space)
        row = np.repeat(np.array(kept), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        last = np.cumsum(lengths) - 1
        after = np.arange(1, len(row) + 1)
        after[last] = len(row)
        # The last half alone is a passage only where there is no other.
        alone = np.zeros(len(row), bool)
        alone[last] = place[last] > 0
        use = np.flatnonzero(~alone)
        leaked: dict[tuple[int, int], tuple[float, float]] = {}
        for cut in range(0, len(use), 4096):
            best: dict[tuple[int, int, int], float] = {}
            for at in range(cut, min(cut + 4096, len(use)), _HELD):
                part = use[at : min(at + _HELD, cut + 4096)]
                near = (_unit(halves[part] + halves[after[part]]) @ asked.T).ravel()
                found = np.flatnonzero(near >= cosine)
                hit, span = np.divmod(found, len(asked))
                for p, i, c in zip(part[hit].tolist(), of[span].tolist(), near[found].tolist(), strict=True):
                    key = (int(row[p]), int(place[p]), i)
                    best[key] = max(best.get(key, -1.0), c)
            for (r, p, i), c in sorted(best.items(), key=lambda x: -x[1]):
                if (r, i) in leaked:
                    continue
                item = items[i]
                reach = (len(item.words) + 1) // 2 + HALF
                region = hashes[r][max(0, p * HALF - reach) : (p + 2) * HALF + reach].tolist()
                share, leak = judge(region, item)
                if leak:
                    leaked[r, i] = (c, share)
        return [(r, i, c, s) for (r, i), (c, s) in leaked.items()]

    return search


def _benchmark_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows, held = benchmark.select("item_id", text_of("text"), answer.alias("answer")).toLocalIterator(), []
    for item in rows:
        held.append(tuple(item))
        if len(held) >= block:
            yield held
            held = []
    if held:
        yield held


def fit_space(hashed: DataFrame, benchmark: DataFrame, weighed: int = WEIGHED) -> tuple[np.ndarray, np.ndarray]:
    """IDF of the features over all documents' passages, and IDF-weighted latent space of
    all passages of documents and benchmark.

    ``hashed`` are the ``hashed_words`` of the documents. Of more than ``weighed``
    passages on either side each weighs the less, so that neither side drowns the other.
    """
    counts = _passage_counts(passage_stats(hashed))
    idf = np.maximum(np.log((1 + counts[-1]) / (1 + counts[:-1])), 0)
    items = benchmark.select(F.lit(None).cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    asked = written(hashed_words(items), "leak-asked")
    n_asked = _passage_counts(passage_stats(asked))[-1]

    def weight(own: float, passages: float) -> Column:
        return F.lit(float(own * np.sqrt(weighed / max(weighed, passages))))

    both = hashed.select("words", weight(1.0, counts[-1]).alias("weight")).unionByName(
        asked.select("words", weight(ASKED_WEIGHT, n_asked).alias("weight"))
    )
    # A task's part of a sum is large whatever it reads: no more of them than run at a time.
    tasks = min(hashed.sparkSession.sparkContext.defaultParallelism, int((counts[-1] + n_asked) // FIT_PASSAGES) + 1)
    space = latent_space(both.coalesce(tasks), idf)
    space[:-1] *= idf.astype(np.float32)[:, None]
    return idf, space


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, weighed: int = WEIGHED, block: int = BLOCK
) -> DataFrame:
    """``doc_id, item_id, cosine, share``: the benchmark items that leak into documents.

    ``benchmark`` has ``item_id, text`` and may have ``answer``. One row for each row of
    ``docs`` and item: ``share`` of the item's words is there in order, around the
    passage of the best ``cosine``. Null and empty texts, and items without words, give
    nothing; null ids are carried; repeated rows are each reported. Items that repeat an
    id are searched each and may report it twice. Other columns are ignored, whatever
    their names.
    """
    return _leaks_of(written(hashed_words(docs), "leak-words"), benchmark, cosine, weighed, block).drop("mark")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, weighed: int = WEIGHED, block: int = BLOCK
) -> DataFrame:
    """``docs``, all columns, without the rows that any benchmark item leaks into.

    Rows that share id and text go together; columns may have any names.
    """
    leaks = _leaks_of(written(hashed_words(docs), "leak-words"), benchmark, cosine, weighed, block)
    gone, some = written_counted(leaks.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "leak-rows")
    if not some:
        return docs
    rows = docs.select(
        F.struct("*").alias("row"), F.col("`doc_id`").cast("long").alias("id"), F.unhex(F.md5(text_of("`text`"))).alias("mark")
    )
    here = rows["id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark"))
    return rows.join(F.broadcast(gone) if some <= MAX_BROADCAST_ROWS else gone, here, "left_anti").select("row.*")


def _leaks_of(hashed: DataFrame, benchmark: DataFrame, cosine: float, weighed: int, block: int) -> DataFrame:
    """``doc_id, mark, item_id, cosine, share`` of the leaks in documents of ``hashed_words``."""
    spark = hashed.sparkSession
    idf, space = fit_space(hashed, benchmark, weighed)
    shared = spark.sparkContext.broadcast(space)
    schema = "doc_id long, mark binary, item_id long, cosine double, share double"
    out = spark.createDataFrame([], schema)
    for rows in _benchmark_blocks(benchmark, block):
        items = _items(rows, idf)
        if not items:
            continue
        asked = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            find = _leaks(asked.value, shared.value, cosine)
            for batch in slices(batches, 64):
                leaks = find(_words_of(batch))
                if leaks:
                    at = pa.array([r for r, *_ in leaks])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(at),
                            batch.column("mark").take(at),
                            pa.array([asked.value[i].item_id for _, i, _, _ in leaks], pa.int64()),
                            pa.array([c for _, _, c, _ in leaks], pa.float64()),
                            pa.array([s for *_, s in leaks], pa.float64()),
                        ],
                        ["doc_id", "mark", "item_id", "cosine", "share"],
                    )

        out = out.unionByName(hashed.mapInArrow(search, schema))
    return out
