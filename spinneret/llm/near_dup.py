"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is a set of word shingles. Its sketch has a fixed number of coordinates that
are filled in rounds: in each of the first t rounds every shingle is hashed to one of t
bins with a value that grows with the round, in the next t rounds all shingles go to one
bin after the other, and the rounds end as soon as every bin holds a value. So each
coordinate is filled, two sketches agree in a coordinate with the probability of their
sets' Jaccard similarity, and the share of agreeing coordinates is as concentrated as
with independent hash functions.

Sketches are cut into bands; documents that agree in a band are candidates. Equal sets
are one node from the start. In each bucket all nodes are verified against a few of them,
first one and then eight others, unless links already connect the two. What remains are
nodes outside the largest connected part of some bucket of theirs. Per such part, these
nodes are verified against the part and each other, in cells of a bounded number of sets,
so that no candidate link between parts is lost, and none is emitted that is not a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinneret.llm.common import NOT_SPACE, WordHashes, bounded_batches, mixed, slices, text_of, texts
from spinneret.session import written, written_counted

# At a similarity of 0.8 a pair shares none of 32 bands of 5 with probability 3e-6.
BANDS, BAND_ROWS = 32, 5
SHINGLE = 2
# Nodes of a bucket that all others are compared with, in each round.
ROUNDS = (1, 8)
# Sets on either side of a cell.
CELL = 256
# Narrow rows that a file of an intermediate table holds, where their number is bounded.
FILE_ROWS = 50_000
PERCENT = 80

_EMPTY = np.iinfo(np.uint64).max
_GOLDEN = 0x9E3779B97F4A7C15


def _numbered(i: int) -> np.uint64:
    return np.uint64((i + 1) * _GOLDEN & (2**64 - 1))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``k`` words, or of all words if fewer."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = mixed(hashes[: n - k + 1] ^ _numbered(k))
    for j in range(1, k):
        out = mixed(out ^ hashes[j : n - k + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each set, none of them empty, in rounds over all sets together."""
    found = np.full(len(sets) * t, _EMPTY)
    if not sets:
        return found.reshape(0, t)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        hashed = mixed(x ^ _numbered(1000 + i))
        place = (hashed >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(x), i - t, np.uint64)
        value = np.uint64(i << 54) | (mixed(hashed) >> np.uint64(10))
        np.minimum.at(found, owner * t + place.astype(np.int64), value)
        open_ = (found.reshape(-1, t) == _EMPTY).any(1)
        left = open_[owner]
        if not left.any():
            break
        x, owner = x[left], owner[left]
    return found.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each sketch; equal for equal bands of the same number."""
    cut = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.array([_numbered(b) for b in range(bands)]), cut.shape[:2])
    for r in range(rows):
        key = mixed(key ^ cut[:, :, r])
    return key.view(np.int64)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


class _Sets:
    """Shingle sets of texts, with the word hashes of one task."""

    def __init__(self, k: int):
        self.hashes, self.k = WordHashes(), k

    def of(self, text: bytes) -> np.ndarray:
        return shingle_set(self.hashes.of(text.lower().split()), self.k)


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, mark, n, node, keys``: digests of each row's text and of its set, the
    set's size and its band keys.

    ``node`` and ``keys`` are null for texts without words.
    """
    bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Sets(k)
        for batch in slices(batches, 256):
            sets = [maker.of(x) for x in texts(batch)]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketches(full, bands * rows), bands, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "mark", "n", "node", "keys"],
            )

    return _marked(docs).mapInArrow(sketch, "doc_id long, mark binary, n long, node binary, keys array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: rows with the digest of their text."""
    text = text_of("`text`")
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text.alias("text"), _mark(text).alias("mark"))


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, set``: the full set of each of ``nodes`` (node, place), from their texts."""
    bounded_batches(docs.sparkSession)
    where = nodes.select(F.col("node").alias("_node"), F.col("place.doc_id").alias("_id"), F.col("place.mark").alias("_mark"))
    named = _marked(docs)
    here = named["doc_id"].eqNullSafe(where["_id"]) & (named["mark"] == where["_mark"])
    read = named.join(where, here).select("text", "_node")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Sets(k)
        for batch in slices(batches, 256):
            names = batch.column("_node").to_pylist()
            found = [(node, s.tobytes()) for s, node in zip(map(maker.of, texts(batch)), names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["node", "set"]
            )

    return read.mapInArrow(full, "node binary, set binary").groupBy("node").agg(F.max("set").alias("set"))


def _in_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, in no more partitions than they fill."""
    return df.coalesce(_files(rows))


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    # The member first: it stands in few pairs, while a bucket's first node may be in many.
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a"
    )

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(similar, "a binary, b binary")


def _links_between(
    families: DataFrame, sets: DataFrame, percent: int, cell: int = CELL, count: int | None = None
) -> DataFrame:
    """``a, b``: links from the nodes that are ``out`` of a family to all its nodes.

    ``count`` is a bound on the rows of ``families``.

    A family is dealt into cells of at most about ``cell`` sets on either side, so none
    is ever in one task; a node is repeated once for each block of the other side.
    """
    size = families.groupBy("family").agg(
        F.ceil(F.count(F.when(F.col("out"), 1)) / cell).cast("int").alias("rows"),
        F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("columns"),
    )
    size = written(size if count is None else _in_files(size, count), "near-cells")
    placed = families.join(size, "family").join(sets, "node")
    block = F.xxhash64("node")

    def dealt(side: int, own: str, other: str) -> DataFrame:
        of = placed.where("out") if side == 0 else placed
        mine, others = F.pmod(block, F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        both = (mine.alias("i"), others.alias("j")) if side == 0 else (others.alias("i"), mine.alias("j"))
        return of.select("family", *both, F.lit(side).alias("side"), "node", "label", "set")

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        nodes, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        out, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(out) and len(all_):
            values = np.concatenate([found[z] for z in all_])
            owner = np.repeat(np.arange(len(all_)), [len(found[z]) for z in all_])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            sizes = np.array([len(found[z]) for z in all_])
            for x in out:
                low, high = np.searchsorted(values, found[x]), np.searchsorted(values, found[x], "right")
                length = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                common = np.bincount(owner[at], minlength=len(all_))
                for z in all_[100 * common >= percent * (len(found[x]) + sizes - common)]:
                    if label[x] != label[z]:
                        a.append(min(nodes[x], nodes[z]))
                        b.append(max(nodes[x], nodes[z]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    cells = dealt(0, "rows", "columns").unionAll(dealt(1, "columns", "rows"))
    return cells.groupBy("family", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def components(edges: DataFrame, size: int | None = None) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (a, b) reaches.

    ``size`` is a bound on the number of edges; each round's tables are as many files as
    that needs.

    Labels pass over edges and then to the label's own label, so that distances double;
    every round is written to the shared folder. Ends when a round changes nothing.
    """

    def kept(df: DataFrame, label: str) -> DataFrame:
        return written(df if size is None else _in_files(df, 2 * size), label)

    both = kept(edges.union(edges.select("b", "a")).distinct().toDF("u", "v"), "near-edges")
    labels = kept(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "near-labels"
    )
    while True:
        heard = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(
            F.min("label").alias("heard")
        )
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = near.join(jump, "label").select("node", "old", F.least("label", "next").alias("label"))
        after = kept(after, "near-labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Sets of ``k``-word shingles (letters A to Z lower-cased; all words if fewer) are
    linked if ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id reachable over links, its own included. Null and empty texts and those
    of white space only have size 0 and are linked with nothing. Rows that repeat an id
    are nodes by their texts, and kept if the id is their component's. Rows without an
    id are linked like others but never give a component its id; where no row has one,
    ``component_id`` is null and all are kept. Other columns of ``docs`` are ignored,
    whatever their names. Empty tables give no rows.
    """
    found, _ = _grouped(docs, k, percent, bands, rows)
    return (
        found.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _grouped(
    docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = BAND_ROWS
) -> tuple[DataFrame, int]:
    """``doc_id, mark, n, node, label, component_id`` for every row of ``docs``, and a bound
    on their number; rows of a group share ``label``, which is null for texts without words."""
    sketch, total = written_counted(sketched(docs, k, bands, rows), "near-sketch")
    full = sketch.where("node IS NOT NULL")
    place = F.min(F.struct("doc_id", "mark")).alias("place")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), place)
    nodes = written(_in_files(nodes, total), "near-nodes")
    members = full.select("node", "n", F.explode("keys").alias("key")).groupBy("key", "node").agg(F.min("n").alias("n"))
    members, held = written_counted(_in_files(members, bands * total), "near-members")
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    several = written(_in_files(several, held // 2), "near-buckets")
    shared = written(_in_files(members.join(several, "key"), held), "near-shared")
    asked = shared.select("node").distinct().join(nodes, "node")
    sets = written(_full_sets(docs, asked, k), "near-sets")
    edges = labels = None
    most = 0

    def labelled() -> DataFrame:
        """Nodes of shared buckets with the label of the part they are in so far."""
        if labels is None:
            return shared.withColumn("label", F.col("node"))
        return shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def linked(now: DataFrame, others: DataFrame, count: int) -> None:
        """Verify nodes against ``count`` others of their bucket at most, and label anew with what is found."""
        nonlocal edges, labels, most
        alike = 100 * F.least("n", "n_other") >= percent * F.greatest("n", "n_other")
        pairs = (
            now.join(others, "key")
            .where((F.col("label") != F.col("label_other")) & alike)
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
            .distinct()
        )
        pairs, some = written_counted(_in_files(pairs, count * held), "near-pairs")
        if some:
            # Verified in as many tasks as the sets fill, and only then put into few files.
            found = written(_verified(sets, pairs, percent).repartition(_files(some)), "near-links")
            edges = found if edges is None else edges.union(found)
            most += some
            labels = components(edges, most)

    as_other = (
        "key", F.col("node").alias("other"), F.col("label").alias("label_other"), F.col("n").alias("n_other")
    )
    for turn, count in enumerate(ROUNDS):
        now = labelled()
        order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        few = shared.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= count).drop("_turn")
        if labels is None:
            few = few.withColumn("label", F.col("node"))
        else:
            few = few.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        linked(now, few.select(*as_other), count)
    now = labelled()
    parts = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    split = (
        parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1").select("key", F.col("most.label").alias("family"))
    )
    split = written(_in_files(split, held // 2), "near-split")
    families = now.join(split, "key").select(
        "family", "node", "label", "n", (F.col("label") != F.col("family")).alias("out")
    ).distinct()
    families, some = written_counted(_in_files(families, held), "near-families")
    if some:
        found, some = written_counted(_links_between(families, sets, percent, count=some), "near-links")
        if some:
            edges = found if edges is None else edges.union(found)
            labels = components(edges, most + some)
    if labels is None:
        owner = nodes.select("node", F.col("node").alias("label"), F.col("rep").alias("component_id"))
    else:
        placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = written(_in_files(placed.select("node", "label", "rep"), total), "near-placed")
        least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
        least = written(_in_files(least, total), "near-least")
        owner = placed.join(least, "label").select("node", "label", "component_id")
    owner = written(_in_files(owner, total), "near-owner")
    return sketch.select("doc_id", "mark", "n", "node").join(owner, "node", "left"), total


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates.

    Of a group the row with the smallest id stays, ids before none; of rows that share
    this id, or of rows without one, that with the smallest digest of its text, and of
    rows that share id and text one. Null texts and texts without words are in no group
    and stay, but rows that share an id and such a text are one. Columns may have any
    names; empty tables give no rows.
    """
    found, total = _grouped(docs, k, percent)
    found = written(_in_files(found.select("doc_id", "mark", "label"), total), "near-found")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    first = found.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    first = written(_in_files(first, total), "near-first")
    text = text_of("`text`")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("`doc_id`").cast("long").alias("id"), _mark(text).alias("mark"),
        text.rlike(NOT_SPACE).alias("words"),
    )

    def those(of: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return of.join(keys, of["id"].eqNullSafe(keys["_id"]) & (of["mark"] == keys["_mark"]), how)

    kept = those(rows.where("words"), first, "left_semi").unionByName(rows.where("NOT words"))
    repeats = found.where("label IS NOT NULL OR doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("c"))
    twins = repeats.where("c > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    twins, some = written_counted(_in_files(twins, total), "near-twins")
    if some:
        one = those(kept, twins, "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row")).select("row")
        kept = those(kept, twins, "left_anti").select("row").unionByName(one)
    return kept.select("row.*")
