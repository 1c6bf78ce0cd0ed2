"""Centroid clustering filtered by ball trees: whole balls go to one centroid where the triangle inequality allows it.

Vectors are turned into integers and dealt into metric trees, a few thousand vectors each, which are written once. A node
stores its ball (centre, radius), its count and its integer sum. A round sends every tree the centroids: a
ball that is nearer to one centroid than to all others by more than its diameter gives its count and sum to it at once, others are descended, and
leaves are compared exactly. Sums of a round are added up by Spark; the driver gets one row a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written

#: Vectors of a tree and of a leaf.
TREE, LEAF = 8192, 24
#: Components up to this size have squared distances that a long holds; up to the smaller one they are exact in floating point.
MOST, EXACT_FLOAT = 2**27, 2**21
#: How much nearer a centroid has to be than rounding could make it.
SLACK = 1e-6


def _splits(x: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, left, right) of each node, parents first; x is put in order on the way. -1: a leaf."""
    queue, n = [(0, len(x))], 1
    for start, end in queue:
        part = x[start:end]
        spread = part[:, :-1].max(axis=0) - part[:, :-1].min(axis=0)
        if end - start <= LEAF or not spread.any():
            yield start, end, -1, -1
            continue
        middle = (end - start) // 2
        part[:] = part[np.argpartition(part[:, int(spread.argmax())], middle)]
        queue += [(start, start + middle), (start + middle, end)]
        yield start, end, n, n + 1
        n += 2


class Tree:
    """A ball tree over integer vectors, in flat arrays."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray) -> None:
        self.x, self.nodes = x, nodes
        total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
        self.count = nodes[:, 1] - nodes[:, 0]
        self.sum = total[nodes[:, 1]] - total[nodes[:, 0]]
        self.centre = self.sum / self.count[:, None]

    @classmethod
    def of(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order that its vectors are in."""
        tagged = np.column_stack([x, np.arange(len(x))])
        nodes = np.array(list(_splits(tagged)), np.int64)
        return cls(np.ascontiguousarray(tagged[:, :-1]), nodes), tagged[:, -1]

    def radii(self) -> np.ndarray:
        return np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(self.nodes, self.centre, strict=True)])

    def assigned(self, radius: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and sums of each centroid, and the centroid of every vector, each exact."""
        k = len(centroids)
        counts, sums, own = np.zeros(k, np.int64), np.zeros((k, self.x.shape[1]), np.int64), np.zeros(len(self.x), np.int64)
        front, leaves = np.zeros(1, np.int64), []
        while len(front):
            far = np.sqrt(((self.centre[front, None, :] - centroids[None]) ** 2).sum(axis=2))
            near = far.argmin(axis=1)
            at = np.arange(len(front))
            gap = far - far[at, near][:, None]
            gap[at, near] = np.inf
            sure = gap.min(axis=1) > 2 * radius[front] + SLACK * (1 + far.max(axis=1))
            np.add.at(counts, near[sure], self.count[front[sure]])
            np.add.at(sums, near[sure], self.sum[front[sure]])
            for (a, b, _, _), c in zip(self.nodes[front[sure]], near[sure], strict=True):
                own[a:b] = c
            left = front[~sure]
            leaf = self.nodes[left, 2] < 0
            leaves.append(left[leaf])
            front = self.nodes[left[~leaf], 2:].ravel()
        spans = self.nodes[np.concatenate(leaves), :2] if leaves else np.zeros((0, 2), np.int64)
        rows = np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else np.zeros(0, np.int64)
        nearest = squared(self.x[rows], centroids).argmin(axis=1)
        own[rows] = nearest
        counts += np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, self.x[rows])
        return counts, sums, own


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_FLOAT:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def kept(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of long): vectors of dims finite components, each floor(scale * x)."""
    x = F.col("x")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where((F.size(x) == dims) & ~F.exists(x, bad))
    too_far = F.exists(x, lambda c: F.abs(scale * c) >= MOST)
    v = F.transform(x, lambda c: F.floor(scale * c))
    return rows.select("vec_id", F.when(too_far, F.raise_error(F.lit(f"a component of {MOST // scale} or more: squared distances don't fit into a long"))).otherwise(v).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose id has the smallest digest; vectors without an id come last, equal ids by vector."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    top = rows.select(F.coalesce(digest, F.lit("~")).alias("d"), "v").orderBy("d", "v").limit(k).collect()
    return np.array([r["v"] for r in top], np.int64)


def trees(rows: DataFrame, dims: int) -> DataFrame:
    """Rows of tree nodes and vectors as bytes: one tree for each TREE vectors of a task, with the vectors' ids."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def grown(part: pa.Table) -> Iterator[pa.RecordBatch]:
            flat = part.column("v").combine_chunks().flatten().to_numpy()
            tree, order = Tree.of(flat.reshape(-1, dims))
            ids = part.column("vec_id").combine_chunks().take(pa.array(order))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([tree.x.astype("<i4").tobytes()]), pa.array([tree.nodes.astype("<i4").tobytes()]),
                pa.array([tree.radii().tobytes()])], ["ids", "x", "nodes", "radius"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= TREE:
                whole = pa.Table.from_batches(held)
                yield from grown(whole.slice(0, TREE))
                held, n = whole.slice(TREE).to_batches(), n - TREE
        if n:
            yield from grown(pa.Table.from_batches(held))

    return rows.mapInArrow(build, f"ids array<{kind}>, x binary, nodes binary, radius binary")


def _opened(b: pa.RecordBatch, dims: int) -> Iterator[tuple[Tree, np.ndarray, pa.Array]]:
    for ids, x, nodes, radius in zip(*(b.column(c) for c in ("ids", "x", "nodes", "radius")), strict=True):
        tree = Tree(np.frombuffer(x.as_py(), "<i4").reshape(-1, dims).astype(np.int64), np.frombuffer(nodes.as_py(), "<i4").reshape(-1, 4).astype(np.int64))
        yield tree, np.frombuffer(radius.as_py(), float), ids.values


def _moved(forest: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Centroids after one round; the driver gets a count and a sum of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, radius, _ in _opened(b, dims):
                counts, sums, _ = tree.assigned(radius, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    # a tree is at most TREE vectors, so that its sums fit into a long; those of all trees may not
    whole = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    found = forest.mapInArrow(run, "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *whole).where("n > 0").collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that is kept.

    Kept are vectors of exactly dims components, none null or non-finite; one that a long's distances couldn't hold (a component of 131,072 or more at a
    scale of 1,024) is an error. Ties go to the smaller number; a centroid without vectors stays where it is. Repeated rows are
    vectors of their own; vectors without an id never start as centroids while others are left. Fewer vectors than k make fewer centroids; an empty table gives an empty result.
    Other columns aren't read. Rounds end early where no centroid moves, as all later ones would be the same.
    """
    rows = kept(vectors, dims, scale, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, salt)
    forest = written(trees(rows, dims))
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, _moved(forest, centroids, dims)
        if (before == centroids).all():
            break

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, radius, ids in _opened(b, dims):
                own = tree.assigned(radius, centroids)[2]
                far = ((tree.x - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    found = forest.mapInArrow(last, f"vec_id {kind}, cluster int, distance long")
    return found.transform(lambda t: _with_totals(t, [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]))


def _with_totals(found: DataFrame, digests: list[str]) -> DataFrame:
    """Adds distances summed over clusters and over all; a row a cluster is all that is broadcast."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(whole("distance").alias("c")).withColumn("one", F.lit(1))
    both = sums.join(sums.groupBy("one").agg(F.sum("c").alias("t")), "one").select("cluster", F.col("c").cast("long").alias("cluster_inertia"), F.col("t").cast("long").alias("inertia"))
    digest: Column = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1) if digests else F.lit(None).cast("string")
    return found.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
