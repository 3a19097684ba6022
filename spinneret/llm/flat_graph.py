"""Near-duplicate embeddings by range search in a robust-pruned flat graph.

Equal vectors of a label are one node. The nodes of a label are dealt into shards around
leaders, sampled nodes that are far from each other; a node goes to the shard of its
nearest leader, its home, and to those of the next ones that a link could reach across,
so that shards overlap. Shards that are still too large are dealt again. In each shard a
graph is built: the candidates of a node are its nearest nodes in the shard and some
drawn by hash, cut by robust pruning (a candidate goes if a chosen one is nearer to it,
by a factor, than the node), with links back. The adjacency lists that a node has in
its shards are united.

Every node is searched for in its home shard: greedily from the shard's medoid and from
the node's own place with a beam, then over all nodes within range and their neighbours
until no new one is in range. All distances are cosines in double precision, so every
link found is verified. A task returns counts and a spanning forest of its links, never
pairs. Recall is audited on a bounded set of nodes against all others; if it is too low,
shards overlap more and the search is run again.

A large shard whose sample has no two leaders is one dense group, nearly all of which
is linked: it is compared in cells of a bounded number of nodes, without a graph.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import Scratch
from spinneret.llm.near_dup import components
from spinneret.llm.vectors import vector_batches

COSINE = 0.93
# Nodes that a shard may hold, and those that it has on average after a deal.
LIMIT, TARGET = 4096, 1024
# Leaders of one deal, sampled nodes they are chosen from, and the cosine they stay under.
LEADERS, SAMPLE, APART = 64, 1024, 0.7
OVERLAP = 3
# Graph: nearest candidates, drawn candidates, out-links, pruning factor, beam.
NEAREST, DRAWN, DEGREE, ALPHA, BEAM = 32, 16, 24, 1.2, 16
_SURE = 4
# Nodes that recall is audited on, and the recall that ends the search.
AUDIT, RECALL = 256, 0.98
_DEEPEST = 8
_BLOCK = 256

_MEMBERS = "shard string, node binary, home boolean, w long, vec array<double>"
_FOUND = "node binary, links long, other binary"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; none of them zero."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def leaders_of(vectors: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """Places of rows, first come first, that are pairwise less alike than ``apart``."""
    chosen: list[int] = []
    alike = np.full(len(vectors), -1.0)
    for i in range(len(vectors)):
        if alike[i] < apart:
            chosen.append(i)
            if len(chosen) == most:
                break
            alike = np.maximum(alike, vectors @ vectors[i])
    return np.array(chosen, int)


def shards_of(vectors: np.ndarray, leaders: np.ndarray, overlap: int, reach: float) -> list[np.ndarray]:
    """Leaders of each row, nearest first: those across whose border a link may reach.

    A vector within ``reach`` of this one can only have another nearest leader if the
    border between the two leaders is within ``reach``.
    """
    cosine = vectors @ leaders.T
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :overlap]
    best = np.take_along_axis(cosine, order, 1)
    between = np.sqrt(np.maximum(2 - 2 * leaders @ leaders.T, 1e-12))
    border = (best[:, :1] - best) / between[order[:, :1], order]
    border[:, 0] = 0
    return [o[b <= reach] for o, b in zip(order, border, strict=True)]


def robust_pruned(
    vectors: np.ndarray, nearest: int = NEAREST, drawn: int = DRAWN, degree: int = DEGREE, alpha: float = ALPHA
) -> list[np.ndarray]:
    """Adjacency lists of a graph over the rows, links back included.

    A list keeps the nearest ``2 * degree`` of what a node chose and of the nodes that
    chose it, and every node that has it among its ``_SURE`` nearest choices: without
    these a node may stand in no list at all.
    """
    n = len(vectors)
    if n < 2:
        return [np.zeros(0, int) for _ in range(n)]
    near, rng = min(nearest, n - 1), np.random.default_rng(n)
    some = rng.permutation(n)[: min(n, 4096)]
    chosen = np.zeros((n, near + drawn), bool)
    candidates = np.zeros((n, near + drawn), int)
    for at in range(0, n, _BLOCK):
        block = np.arange(at, min(at + _BLOCK, n))
        cosine = vectors[block] @ vectors.T
        cosine[np.arange(len(block)), block] = -2
        found = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
        far = some[rng.integers(0, len(some), (len(block), drawn))]
        both = np.concatenate([found, far], 1)
        alike = np.take_along_axis(cosine, both, 1)
        order = np.argsort(-alike, axis=1, kind="stable")
        both, alike = np.take_along_axis(both, order, 1), np.take_along_axis(alike, order, 1)
        alive = alike > -2
        alive[:, 1:] &= both[:, 1:] != both[:, :-1]
        own = np.sqrt(np.maximum(2 - 2 * alike, 0))
        them = vectors[both]
        between = np.sqrt(np.maximum(2 - 2 * (them @ them.transpose(0, 2, 1)), 0))
        taken = np.zeros(len(block), int)
        for j in range(both.shape[1]):
            pick = alive[:, j] & (taken < degree)
            chosen[block, j] = pick
            taken += pick
            alive[:, j] = False
            alive &= ~(pick[:, None] & (alpha * between[:, j] <= own))
        candidates[block] = both
    source, target = np.nonzero(chosen)[0], candidates[chosen]
    first = chosen & (np.cumsum(chosen, axis=1) <= _SURE)
    sure = np.unique(candidates[first] * n + np.nonzero(first)[0])
    pairs = np.unique(np.concatenate([source * n + target, target * n + source]))
    source, target = pairs // n, pairs % n
    alike = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-alike, source))
    pairs, source, target = pairs[order], source[order], target[order]
    starts = np.searchsorted(source, np.arange(n + 1))
    keep = (np.arange(len(source)) - starts[source] < 2 * degree) | np.isin(pairs, sure)
    source, target = source[keep], target[keep]
    starts = np.searchsorted(source, np.arange(n + 1))
    return [target[starts[i] : starts[i + 1]] for i in range(n)]


class Graph:
    """Vectors of a shard with their neighbours, one list after the other."""

    def __init__(self, vectors: np.ndarray, adjacent: list[np.ndarray]):
        self.vectors = vectors
        self.length = np.array([len(a) for a in adjacent], int)
        self.start = np.cumsum(self.length) - self.length
        self.target = np.concatenate([np.zeros(0, int), *adjacent])
        self.medoid = int(np.argmax(vectors @ vectors.mean(0)))

    def in_range(self, queries: np.ndarray, cosine: float, beam: int = BEAM) -> np.ndarray:
        """For each query node, which nodes the search finds within range (a matrix)."""
        n, q = len(self.vectors), len(queries)
        row = np.arange(q)
        seen, hit = np.zeros((q, n), bool), np.zeros((q, n), bool)
        done = np.zeros((q, n), bool)
        who, score = np.full((q, beam + 2), -1), np.full((q, beam + 2), -2.0)
        for place, start in enumerate((np.full(q, self.medoid), queries)):
            fresh = ~seen[row, start]
            seen[row, start] = True
            alike = np.einsum("ij,ij->i", self.vectors[queries], self.vectors[start])
            hit[row, start] |= alike >= cosine
            who[fresh, place], score[fresh, place] = start[fresh], alike[fresh]

        def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unseen neighbours of the nodes, each once for its query, and their cosines."""
            done[rows, nodes] = True
            length = self.length[nodes]
            place = np.arange(length.sum()) + np.repeat(self.start[nodes] - (np.cumsum(length) - length), length)
            rows, near = np.repeat(rows, length), self.target[place]
            fresh = ~seen[rows, near]
            key = np.unique(rows[fresh] * n + near[fresh])
            rows, near = key // n, key % n
            seen[rows, near] = True
            alike = np.einsum("ij,ij->i", self.vectors[queries[rows]], self.vectors[near])
            hit[rows, near] = alike >= cosine
            return rows, near, alike

        while True:
            open_ = (who >= 0) & ~done[row[:, None], who]
            best = np.where(open_, score, -3.0).argmax(1)
            go = row[open_[row, best]]
            if not len(go):
                break
            rows, near, alike = look(go, who[go, best[go]])
            # The new ones of a query side by side, beside its beam; the best stay.
            counts = np.bincount(rows, minlength=q)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            more = np.full((2, q, max(1, counts.max(initial=0))), -2.0)
            more[0, rows, place], more[1, rows, place] = near, alike
            who = np.concatenate([who, np.where(more[1] > -2, more[0], -1).astype(int)], 1)
            score = np.concatenate([score, more[1]], 1)
            keep = np.argpartition(-score, beam, axis=1)[:, : beam + 2]
            who, score = np.take_along_axis(who, keep, 1), np.take_along_axis(score, keep, 1)
        while True:
            rows, nodes = np.nonzero(hit & ~done)
            if not len(rows):
                break
            for at in range(0, len(rows), 4096):
                look(rows[at : at + 4096], nodes[at : at + 4096])
        hit[row, queries] = False
        return hit


class Forest:
    """Parts of a set of nodes that links join."""

    def __init__(self, n: int):
        self.part = np.arange(n)

    def link(self, node: int, others: np.ndarray) -> None:
        met = np.unique(self.part[np.append(others, node)])
        if len(met) > 1:
            self.part[np.isin(self.part, met)] = met[0]


def _found(nodes: list[bytes], links: dict[int, int], forest: Forest) -> pa.Table:
    """Counts, and a link from each node to the first of its part."""
    there = np.flatnonzero(forest.part != np.arange(len(nodes)))
    counted = list(links)
    return pa.table(
        {
            "node": pa.array([nodes[i] for i in counted] + [nodes[i] for i in there], pa.binary()),
            "links": pa.array([links[i] for i in counted] + [0] * len(there), pa.int64()),
            "other": pa.array([None] * len(counted) + [nodes[forest.part[i]] for i in there], pa.binary()),
        }
    )


def _rows(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    flat = table.column(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _nodes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``vec_id, node`` of all rows, and ``node, rep, w, shard, vec`` of the distinct ones."""
    # Lists of other than numbers, zero vectors and rows without a label get no node.
    read = vectors.select(
        F.col("`vec_id`").cast("long").alias("vec_id"),
        F.col("`label`").cast("string").alias("label"),
        F.col("`embedding`").cast("array<double>").alias("vec"),
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, label = batch.column("vec"), batch.column("label").to_pylist()
            flat = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            ends = column.offsets.to_numpy()
            nodes = []
            for i, there in enumerate(column.is_valid().to_pylist()):
                v = flat[ends[i] : ends[i + 1]] + 0.0  # no negative zeros
                sound = there and label[i] is not None and len(v) and np.isfinite(v).all() and v.any()
                name = f"{len(v)}:{label[i]}:".encode()
                nodes.append(hashlib.blake2b(name + v.tobytes(), digest_size=16).digest() if sound else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), column, pa.array(nodes, pa.binary())],
                ["vec_id", "label", "vec", "node"],
            )

    rows = scratch.write(read.mapInArrow(digest, "vec_id long, label string, vec array<double>, node binary"), "graph-rows")
    nodes = scratch.write(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count(F.lit(1)).alias("w"),
            F.first(F.concat(F.size("vec").cast("string"), F.lit(":"), "label")).alias("shard"),
            F.first("vec").alias("vec"),
        ),
        "graph-nodes",
    )
    return rows, nodes


def _dealt(nodes: DataFrame, overlap: int, reach: float, scratch: Scratch, limit: int, target: int) -> tuple[DataFrame, list]:
    """``shard, node, home, w, vec``, and the tables it reads. Shards of more than
    ``limit`` nodes are dealt until their sample is one dense group."""
    members = nodes.select("shard", "node", F.lit(True).alias("home"), "w", "vec")
    final, held = None, []
    for _ in range(_DEEPEST):
        sizes = scratch.write(members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "graph-sizes")
        held.append(sizes)
        if sizes.isEmpty():
            break
        drawn = members.join(sizes, "shard").where(
            F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")
        )

        def choose(table: pa.Table) -> pa.Table:
            vectors, n = unit(_rows(table, "vec")), table.column("n")[0].as_py()
            vectors = vectors[np.argsort(np.array(table.column("node").to_pylist(), object))]
            chosen = leaders_of(vectors, min(LEADERS, -(-n // target)))
            return pa.table(
                {
                    "shard": pa.array([table.column("shard")[0].as_py()] * len(chosen), pa.string()),
                    "vec": pa.array(list(vectors[chosen]), pa.list_(pa.float64())),
                    "n": pa.array([n] * len(chosen), pa.int64()),
                }
            )

        leaders = drawn.groupBy("shard").applyInArrow(choose, "shard string, vec array<double>, n long")
        leaders = scratch.write(leaders, "graph-leaders")
        held.append(leaders)
        split = leaders.groupBy("shard").agg(F.count(F.lit(1)).alias("leaders")).where("leaders > 1").select("shard")
        split = scratch.write(split, "graph-split")
        held.append(split)
        if split.isEmpty():
            break
        settled = members.join(split, "shard", "left_anti")
        final = settled if final is None else final.unionByName(settled)
        # Members and the leaders of their shard meet in groups of a bounded size.
        salts = F.ceil(F.col("n") / 8192).cast("int")
        salted = members.join(split, "shard").join(sizes, "shard").select(
            "shard", F.pmod(F.xxhash64("node", F.lit(3)), salts).cast("int").alias("salt"), "node", "home", "w", "vec"
        )
        copies = leaders.join(split, "shard").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "vec")

        def deal(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"shard": [], "node": [], "home": [], "w": [], "vec": []}, schema=_member_schema())
            vectors, chosen = unit(_rows(left, "vec")), unit(_rows(right, "vec"))
            # All groups of a shard number its leaders alike.
            chosen = chosen[np.lexsort(chosen.T[::-1])]
            places = shards_of(vectors, chosen, overlap, reach)
            counts = [len(p) for p in places]
            at = np.repeat(np.arange(len(vectors)), counts)
            first = np.concatenate([np.arange(c) == 0 for c in counts])
            name = left.column("shard")[0].as_py()
            copied = left.take(pa.array(at))
            return pa.table(
                {
                    "shard": pa.array([f"{name}/{x}" for x in np.concatenate(places)], pa.string()),
                    "node": copied.column("node"),
                    "home": pa.array(np.array(copied.column("home").to_pylist()) & first),
                    "w": copied.column("w"),
                    "vec": copied.column("vec"),
                }
            )

        grouped = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
        members = scratch.write(grouped.applyInArrow(deal, _MEMBERS), "graph-members")
        held.append(members)
    final = members if final is None else final.unionByName(members)
    done = scratch.write(final, "graph-shards")
    scratch.drop(*held)
    return done, [done]


def _member_schema() -> pa.Schema:
    return pa.schema(
        [("shard", pa.string()), ("node", pa.binary()), ("home", pa.bool_()), ("w", pa.int64()), ("vec", pa.list_(pa.float64()))]
    )


def _credit(queries, others, hit, homes, shards, weight, own: str, links: dict[int, int]) -> None:
    """Count what each query found; also for nodes whose own search cannot see the query."""
    away = np.array([h != own for h in homes], bool)
    for row in np.flatnonzero(hit.any(1)):
        u, found = queries[row], others[hit[row]]
        links[u] = links.get(u, 0) + int(weight[found].sum())
        for v in found[away[found]]:
            if homes[v] not in shards[u]:
                links[v] = links.get(v, 0) + int(weight[u])


def _searched(members: DataFrame, scratch: Scratch, cosine: float, limit: int) -> DataFrame:
    """``node, links, other``: counts of links (``other`` null), and links of a forest."""
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    sized = members.join(scratch.write(sizes, "graph-sizes"), "shard")
    small, dense = sized.where(F.col("n") <= limit).drop("n"), sized.where(F.col("n") > limit)

    def build(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        adjacent = robust_pruned(unit(_rows(table, "vec"))[order])
        names = [nodes[i] for i in order]
        return pa.table(
            {
                "node": pa.array(names, pa.binary()),
                "near": pa.array([[names[j] for j in a] for a in adjacent], pa.list_(pa.binary())),
            }
        )

    near = small.groupBy("shard").applyInArrow(build, "node binary, near array<binary>")
    # A node has one list for each of its shards, at most overlap to the power of the deals.
    place = members.groupBy("node").agg(
        F.collect_list("shard").alias("shards"), F.max(F.when(F.col("home"), F.col("shard"))).alias("home_shard")
    )
    united = near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    known = scratch.write(place.join(united, "node", "left"), "graph-adjacency")

    def search(table: pa.Table) -> pa.Table:
        nodes, own = table.column("node").to_pylist(), table.column("shard")[0].as_py()
        at = {x: i for i, x in enumerate(nodes)}
        near = [np.array([at[x] for x in a or () if x in at], int) for a in table.column("near").to_pylist()]
        graph = Graph(unit(_rows(table, "vec")), near)
        homes, shards = table.column("home_shard").to_pylist(), [set(s) for s in table.column("shards").to_pylist()]
        weight, everyone = np.array(table.column("w").to_pylist()), np.arange(len(nodes))
        asked, links, forest = np.flatnonzero(table.column("home").to_pylist()), {}, Forest(len(nodes))
        for start in range(0, len(asked), _BLOCK):
            queries = asked[start : start + _BLOCK]
            hit = graph.in_range(queries, cosine)
            for row in np.flatnonzero(hit.any(1)):
                forest.link(queries[row], np.flatnonzero(hit[row]))
            _credit(queries, everyone, hit, homes, shards, weight, own, links)
        return _found(nodes, links, forest)

    found = small.join(known, "node").groupBy("shard").applyInArrow(search, _FOUND)
    if dense.isEmpty():
        return found
    # Blocks of a dense shard, each pair of which is a cell.
    blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
    placed = dense.join(known.drop("near"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int"))
    cells = placed.withColumn("against", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "shard", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"),
        "block", "node", "home", "w", "vec", "shards", "home_shard",
    )

    def compare(table: pa.Table) -> pa.Table:
        nodes, own = table.column("node").to_pylist(), table.column("shard")[0].as_py()
        vectors, block = unit(_rows(table, "vec")), np.array(table.column("block").to_pylist())
        homes, shards = table.column("home_shard").to_pylist(), [set(s) for s in table.column("shards").to_pylist()]
        weight, home = np.array(table.column("w").to_pylist()), np.array(table.column("home").to_pylist())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        links, forest = {}, Forest(len(nodes))
        for mine, theirs in {(i, j), (j, i)}:
            others, asked = np.flatnonzero(block == theirs), np.flatnonzero((block == mine) & home)
            for start in range(0, len(asked), _BLOCK):
                queries = asked[start : start + _BLOCK]
                hit = vectors[queries] @ vectors[others].T >= cosine
                hit &= queries[:, None] != others[None, :]
                for row in np.flatnonzero(hit.any(1)):
                    forest.link(queries[row], others[hit[row]])
                _credit(queries, others, hit, homes, shards, weight, own, links)
        return _found(nodes, links, forest)

    return found.unionByName(cells.groupBy("shard", "i", "j").applyInArrow(compare, _FOUND))


def audit_recall(nodes: DataFrame, counted: DataFrame, cosine: float = COSINE, most: int = AUDIT) -> float:
    """Share of the links of a bounded set of nodes that were counted, 1 if there are none.

    The ``most`` nodes with the smallest hashes are compared with all nodes of their label.
    """
    asked = nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(most).select("node", "shard", "vec").collect()
    by_shard: dict[str, tuple[list, np.ndarray]] = {}
    for shard in {r["shard"] for r in asked}:
        own = [r for r in asked if r["shard"] == shard]
        by_shard[shard] = ([bytes(r["node"]) for r in own], unit(np.array([r["vec"] for r in own])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            shard, node = np.array(batch.column("shard").to_pylist(), object), batch.column("node").to_pylist()
            w, vec = np.array(batch.column("w").to_pylist()), batch.column("vec")
            for name, (wanted, there) in by_shard.items():
                at = np.flatnonzero(shard == name)
                if len(at):
                    part = pa.RecordBatch.from_arrays([vec.take(pa.array(at))], ["vec"])
                    hit = there @ unit(_rows(part, "vec")).T >= cosine
                    row_of = {x: row for row, x in enumerate(wanted)}
                    for place, i in enumerate(at):
                        if node[i] in row_of:
                            hit[row_of[node[i]], place] = False
                    for row, x in enumerate(wanted):
                        total[x] = total.get(x, 0) + int(w[at][hit[row]].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["node", "links"])

    real = nodes.select("shard", "node", "w", "vec").mapInArrow(count, "node binary, links long")
    real = real.groupBy("node").agg(F.sum("links").alias("links"))
    got = real.join(counted.select("node", F.col("links").alias("found")), "node", "left").agg(
        F.sum("links").alias("links"), F.sum(F.least("links", F.coalesce("found", F.lit(0)))).alias("found")
    ).first()
    return got["found"] / got["links"] if got["links"] else 1.0


def near_embeddings(
    vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, limit: int = LIMIT, target: int = TARGET
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows of ``vectors (vec_id, embedding, label)`` are linked if their labels are equal
    and not null, their vectors have as many components, and their cosine, in double
    precision, is at least ``cosine``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing: no links, their own id as component.
    ``n_links`` counts the other rows linked directly, equal rows included;
    ``component_id`` is the smallest id reachable over links, and ``kept`` tells whether
    that is the row's own. Rows that repeat an id are rows of their own. Rows without an
    id are linked like others but give a component no id; where no row has one,
    ``component_id`` is null and all are kept. Empty tables give no rows. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    vector_batches(spark)
    scratch = Scratch(spark)
    rows, nodes = _nodes(vectors, scratch)
    reach = float(np.sqrt(2 - 2 * cosine))
    while True:
        members, held = _dealt(nodes, overlap, reach, scratch, limit, target)
        found = scratch.write(_searched(members, scratch, cosine, limit), "graph-found")
        counted = scratch.write(
            found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links")), "graph-counts"
        )
        recall = audit_recall(nodes, counted, cosine)
        logging.getLogger(__name__).info("recall %.4f with overlap %d", recall, overlap)
        scratch.drop(*held)
        if recall >= RECALL or overlap >= LEADERS:
            break
        scratch.drop(found, counted)
        overlap *= 2
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    known = nodes.select("node", "rep", "w").join(labels, "node", "left").join(counted, "node", "left")
    known = scratch.write(
        known.select("node", "rep", "w", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")),
        "graph-known",
    )
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    about = known.join(least, "label").select("node", (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id")
    done = rows.select("vec_id", "node").join(about, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return done.withColumn("kept", F.col("component_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id")))
