"""Approximate nearest neighbours by a forest of random-projection trees.

The distinct vectors are dealt into segments of bounded size by one tree over
a sample; a query goes to the ``PROBES`` segments that are nearest on it. Each
segment builds a forest: every tree splits its vectors at the medians of
random projections, one for each of its levels. A query searches all trees of
a segment through one shared priority queue of nodes, whose priority is the
squared distance to the splits crossed on the way to a node. The near child of
a node costs what the node does, hence the ``LEAVES`` first leaves of the queue
descend from the ``LEAVES`` first nodes of each level; they are found level by
level for a block of queries at once. The ``RERANK`` vectors that most of these
leaves hold are reranked by exact inner products in double precision, and the
best of all segments are merged. What a query costs does not grow with the
table, but for the depth of the trees.

Vectors of unequal length get one more component that makes them equal, so
that the largest inner product is the nearest vector (queries have 0 there).
Equal vectors are indexed once, with the smallest ids that a result can need.

Cases with a defined result: vectors that are null, zero, or hold a null or a
component that is not finite take no part, neither as query nor as candidate;
a query only meets vectors with as many components; a query's own id is left
out, also if it is repeated, and repeated rows of another id count once; ties
go to the smaller id; with fewer candidates than asked for, all are returned;
an empty table gives an empty result; very long vectors make segments of fewer
rows; only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, written

#: Distinct vectors in a segment, and their bytes, about; no segment has more than twice as many.
SEGMENT, SEGMENT_BYTES = 32_768, 64 << 20
#: Vectors of the bounded sample that the tree over the segments is fitted on: so many for each segment, and at most.
SAMPLE_EACH, SAMPLE = 64, 131_072
#: Segments that a query goes to.
PROBES = 8
TREES, LEAF = 64, 100
#: Leaves that a query takes from the queue of a segment, and vectors that it reranks there.
LEAVES, RERANK = 2048, 2048
#: A small segment gives at most one in so many of its leaves.
FEWEST = 4
#: Parts that the ids of one vector are reduced in first.
SALTS = 64
QUERY_BLOCK = 64


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that brings their squared length to ``most``."""
    rest = np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


class Forest:
    """Balanced trees over the rows of a matrix; level l of a tree splits by the tree's l-th random direction."""

    def __init__(self, x: np.ndarray, seed: int, trees: int = TREES, leaf: int = LEAF, depth: int | None = None, most: float | None = None):
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf)))) if depth is None else depth
        self.most = float(np.einsum("ij,ij->i", x, x).max(initial=0)) if most is None else most
        full = lifted(x, self.most)
        self.directions = rng.standard_normal((full.shape[1], trees, self.depth)).astype(np.float32)
        self.splits = [np.empty((trees, 1 << level), np.float32) for level in range(self.depth)]
        size = -(-len(x) // (1 << self.depth))
        self.leaves = np.empty((trees, 1 << self.depth, size), np.int32)
        spare = size * (1 << self.depth) - len(x)
        for t in range(trees):
            at = full @ self.directions[:, t]
            order = np.concatenate([rng.permutation(len(x)), rng.integers(0, max(1, len(x)), spare)])  # filled up with rows that then stand twice
            for level in range(self.depth):
                order = order.reshape(1 << level, -1)
                here = at[order, level]
                half = order.shape[1] // 2
                by = np.argpartition(here, half, axis=1)
                order, here = np.take_along_axis(order, by, 1), np.take_along_axis(here, by, 1)
                self.splits[level][t] = here[:, half]
            self.leaves[t] = order.reshape(1 << self.depth, size)

    def _projected(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to the vectors' length, on all directions."""
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) * np.sqrt(self.most)
        flat = self.directions[:-1].reshape(len(self.directions) - 1, -1)
        return (unit.astype(np.float32) @ flat).reshape(len(q), self.trees, self.depth)

    def first_leaves(self, q: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """The first leaves of each query's queue over all trees (tree * 2^depth + leaf), and their priorities."""
        at = self._projected(q)
        node = np.tile(np.arange(self.trees), (len(q), 1))
        cost = np.zeros(node.shape, np.float32)
        for level in range(self.depth):
            apart = np.take_along_axis(at[:, :, level], node >> level, 1) - self.splits[level].ravel()[node]
            near = (apart >= 0).astype(node.dtype)
            node = np.concatenate([2 * node + near, 2 * node + 1 - near], axis=1)
            cost = np.concatenate([cost, cost + apart * apart], axis=1)
            if node.shape[1] > many:
                by = np.argpartition(cost, many - 1, axis=1)[:, :many]
                node, cost = np.take_along_axis(node, by, 1), np.take_along_axis(cost, by, 1)
        return node, cost

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf of the first tree in which each of the indexed vectors lies."""
        at = lifted(x, self.most) @ self.directions[:, 0]
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + (at[:, level] >= self.splits[level][0][node])
        return node

    def candidates(self, q: np.ndarray, n: int, leaves: int = LEAVES, rerank: int = RERANK) -> list[np.ndarray]:
        """Rows, of n, to rerank for each query: those that most of its leaves hold."""
        if n <= rerank:
            return [np.arange(n)] * len(q)
        found = []
        flat = self.leaves.reshape(-1, self.leaves.shape[2])
        leaves = min(leaves, max(self.trees, len(flat) // FEWEST))  # with all leaves, every row would stand in as many
        for node in self.first_leaves(q, leaves)[0]:
            held = np.bincount(flat[node].ravel(), minlength=n)
            found.append(np.sort(np.argpartition(-held, rerank - 1)[:rerank]))
        return found


def _valid(df: DataFrame) -> DataFrame:
    v = F.col("vector")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(good & F.col("id").isNotNull())


def _distinct(df: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector with its k + 1 smallest ids."""
    first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = df.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(first(F.collect_list("id")).alias("ids"))
    return salted.groupBy("vector").agg(first(F.flatten(F.collect_list("ids"))).alias("ids"))


def _rows(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    return [values[e - c : e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def _routers(index: DataFrame, segment_size: int) -> dict[int, Forest]:
    """For each number of components with more vectors than a segment takes: a tree over a sample, whose leaves are the segments."""
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = index.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(length).alias("most"))
    room = F.greatest(F.lit(256), F.least(F.lit(segment_size), F.floor(F.lit(SEGMENT_BYTES // 8) / F.col("d")))) if segment_size >= 256 else F.lit(segment_size)
    found = {}
    for r in sizes.withColumn("room", room).filter("n > room").collect():  # fewer than there are segments
        depth = int(np.ceil(np.log2(r["n"] / r["room"])))
        depth = min(depth, int(np.log2(SAMPLE // SAMPLE_EACH)))
        every = max(1, r["n"] // min(SAMPLE, SAMPLE_EACH << depth))
        sample = index.filter((F.size("vector") == r["d"]) & (F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(every)) == 0)).select("vector").orderBy(F.xxhash64("vector"))
        x = np.array([v["vector"] for v in sample.collect()])  # bounded by SAMPLE
        if len(x) >= 2 << depth:
            found[r["d"]] = Forest(x, seed=r["d"], trees=1, depth=depth, most=r["most"])
    return found


def _routed(df: DataFrame, routers: dict[int, Forest], probes: int, parts: dict[tuple[int, int], int]) -> DataFrame:
    """Rows (id, vector, ids) with their segment (d, cell, part): vectors (kind 0) in one, queries (kind 1) in those nearest to them, all parts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "mark"))
            vectors = _rows(batch.column("vector"))
            d = np.array([len(v) for v in vectors], np.int64)
            rows: list[tuple[int, int, int, int]] = []
            for dim, k in product(np.unique(d).tolist(), (0, 1)):
                mine = np.flatnonzero((d == dim) & (kind == k))
                if not len(mine):
                    continue
                if (tree := routers.get(dim)) is None:
                    cells = np.zeros((len(mine), 1), np.int64)
                elif k == 0:
                    cells = tree.cells(np.array([vectors[i] for i in mine]))[:, None]
                else:
                    cells = tree.first_leaves(np.array([vectors[i] for i in mine]), probes)[0]
                for i, of_row in zip(mine.tolist(), cells.tolist(), strict=True):
                    for cell in of_row:
                        n = parts.get((dim, cell), 1)
                        rows += [(i, dim, cell, p) for p in ([int(mark[i]) % n] if k == 0 else range(n))]
            at = pa.array([r[0] for r in rows], pa.int32())
            place = [pa.array([r[j] for r in rows], pa.int32()) for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*place, *(batch.column(c).take(at) for c in ("kind", "id", "vector", "ids"))], ["d", "cell", "part", "kind", "id", "vector", "ids"])

    marked = df.withColumn("mark", F.pmod(F.xxhash64("vector", F.lit(2)), F.lit(1 << 30)).cast("int"))
    return marked.mapInArrow(run, "d int, cell int, part int, kind int, id long, vector array<double>, ids array<long>")


class Segment:
    """The vectors of one segment with their forest, built when a query first needs it."""

    def __init__(self, seed: int):
        self.seed, self.rows, self.ids, self.forest = seed, [], [], None

    def add(self, vector: np.ndarray, ids: list[int]) -> None:
        self.rows.append(vector.copy())
        self.ids.append(np.array(ids, np.int64))

    def nearest(self, own: list[int], q: np.ndarray, k: int, leaves: int, rerank: int) -> list[tuple[int, int, float]]:
        if not self.ids:
            return []
        if self.forest is None:
            self.x = np.array(self.rows)
            self.rows = []
            self.forest = Forest(self.x, self.seed)
        out: list[tuple[int, int, float]] = []
        for me, v, c in zip(own, q, self.forest.candidates(q, len(self.x), leaves, rerank), strict=True):
            score = self.x[c] @ v
            if len(c) > k + 1:  # ties at the border stay
                least = np.partition(score, len(c) - k - 1)[len(c) - k - 1]
                c = c[score >= least - 1e-9 * abs(least)]
            exact = [float(np.sum(self.x[j] * v)) for j in c]
            pairs = sorted((-s, int(name)) for j, s in zip(c.tolist(), exact, strict=True) for name in self.ids[j] if name != me)
            out.extend((me, name, -s) for s, name in pairs[:k])
        return out


def search(
    df: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
    segment_size: int = SEGMENT, probes: int = PROBES, leaves: int = LEAVES, rerank: int = RERANK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by inner product."""
    plain = lambda t: _valid(t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")))
    with scratch(df.sparkSession) as keep:
        index = keep(written(_distinct(plain(df), k)))
        routers = _routers(index, segment_size)
    kept = index.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "vector", "ids")
    asked = plain(queries).dropDuplicates(["id", "vector"]).select(F.lit(1).alias("kind"), "id", "vector", F.lit(None).cast("array<long>").alias("ids"))
    parts = {}
    if routers:  # segments that got more than twice their share are split by hash, and queries go to all parts
        counts = _routed(kept, routers, probes, {}).groupBy("d", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * segment_size)
        parts = {(r["d"], r["cell"]): -(-r["n"] // segment_size) for r in counts.collect()}  # fewer than there are segments
    place = ("d", "cell", "part")
    # each segment's vectors come first, its queries stream past them
    dealt = _routed(kept.union(asked), routers, probes, parts).repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment = None, Segment(0)
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
            kind = batch.column("kind").to_pylist()
            vectors, own, id_lists = _rows(batch.column("vector")), batch.column("id").to_pylist(), batch.column("ids").to_pylist()
            out: list[tuple[int, int, float]] = []
            block: list[int] = []

            def flush(block=block, vectors=vectors, own=own, out=out) -> None:
                if block:
                    out.extend(segment.nearest([own[i] for i in block], np.array([vectors[i] for i in block]), k, leaves, rerank))
                    block.clear()

            for i, here in enumerate(at):
                if here != now:
                    flush()
                    now, segment = here, Segment(here[1])
                if kind[i] == 0:
                    segment.add(vectors[i], id_lists[i])
                else:
                    block.append(i)
                    if len(block) == QUERY_BLOCK:
                        flush()
            flush()
            if out:
                a, b, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def contract(df: DataFrame) -> DataFrame:
    return search(df, df.filter("vec_id % 20 = 0"))
