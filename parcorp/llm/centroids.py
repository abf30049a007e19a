"""Vectors grouped around centroids: exact integer means over a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcorp.llm.common import with_package, written

DIM = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
LEAF = 4  # centroids of a leaf
VANTAGE_TRIES = 16
BATCH = 4096  # vectors that are searched at once
LARGEST = 1 << 27  # scaled components up to here keep squared distances within 64 bits
_SLACK = 1e-12  # far above the rounding of the bounds, so that no pruning is too early


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return (diff * diff).sum(axis=-1)


class VantageTree:
    """Whole-number centroids in a vantage-point tree.

    An inner node holds one centroid, its vantage point; of the others the nearer half lies
    in one child, the farther half in the other, and for each child the node knows the
    smallest and the largest distance from the vantage point. Leaves hold a few centroids.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = np.asarray(points, np.int64)
        self.held: list[np.ndarray] = []  # centroids of a leaf, or the vantage point
        self.children: list[list[tuple[int, float, float]]] = []  # node, least and largest distance
        todo = [(self._node(), np.arange(len(self.points)))]
        while todo:
            node, members = todo.pop()
            if len(members) <= leaf:
                self.held[node] = members
                continue
            top, far = self._vantage(members)
            self.held[node] = members[top:top + 1]
            order = np.argsort(far, kind="stable")
            order = order[order != top]
            for half in (order[:len(order) // 2], order[len(order) // 2:]):
                if len(half):
                    child = self._node()
                    self.children[node].append((child, float(far[half].min()), float(far[half].max())))
                    todo.append((child, members[half]))

    def _node(self) -> int:
        self.held.append(np.empty(0, np.int64))
        self.children.append([])
        return len(self.held) - 1

    def _vantage(self, members: np.ndarray) -> tuple[int, np.ndarray]:
        """Of a few members the one whose distances to all others differ most."""
        tries = np.unique(np.linspace(0, len(members) - 1, VANTAGE_TRIES).astype(int))
        far = {int(t): np.sqrt(_squared(self.points[members], self.points[members[t]])) for t in tries}
        top = max(far, key=lambda t: (far[t].std(), -t))
        return top, far[top]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of every row of `q`;
        of equally near ones the smallest number.

        Best first: every vector opens its own nodes in order of their lower bounds, until
        the least bound exceeds its best distance. A bound equal to it is still opened,
        since a tie may hide there. Vectors that open the same node do so together.
        """
        n = len(q)
        who, best = np.full(n, len(self.points), np.int64), np.full(n, np.iinfo(np.int64).max)
        bound, node = np.full((n, 2), np.inf), np.zeros((n, 2), np.int64)
        bound[:, 0] = 0.0
        used, live = np.ones(n, np.int64), np.arange(n)
        while len(live):
            slot = bound[live].argmin(axis=1)
            low = bound[live, slot]
            go = np.isfinite(low) & (low <= np.sqrt(best[live].astype(float)) * (1 + _SLACK))
            live, slot = live[go], slot[go]
            opened = node[live, slot]
            bound[live, slot] = np.inf
            if len(live) and used[live].max() + 1 >= bound.shape[1]:
                bound = np.pad(bound, ((0, 0), (0, bound.shape[1])), constant_values=np.inf)
                node = np.pad(node, ((0, 0), (0, node.shape[1])))
            for v in np.unique(opened):
                rows, free = live[opened == v], slot[opened == v]
                for c in self.held[v]:
                    d2 = _squared(q[rows], self.points[c])
                    better = (d2 < best[rows]) | ((d2 == best[rows]) & (c < who[rows]))
                    best[rows[better]], who[rows[better]] = d2[better], c
                if not self.children[v]:
                    continue
                d = np.sqrt(d2.astype(float))  # an inner node holds its vantage point only
                for i, (child, least, most) in enumerate(self.children[v]):
                    at = free if i == 0 else used[rows]
                    bound[rows, at] = np.maximum(np.maximum(d - most, least - d) - _SLACK * (d + most), 0)
                    node[rows, at] = child
                    used[rows] += i
        return who, best


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component x, as double; rows of equal length."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError("components too large for squared distances of 64 bits")
    return values.astype(np.int64).reshape(len(column), len(values) // max(len(column), 1))


def _batches(stream: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in stream:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            yield part.column(0), whole(part.column(1), scale)


def usable(vectors: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """(id, vector): rows whose vector has exactly `dim` components, all finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(vector).isNotNull() & (F.size(vector) == dim) & ~odd
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(row_id).alias("id"), F.col(vector).alias("vector"))


def first_centroids(rows: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of `seed:id`, in that order; k rows reach the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = rows.select(F.sha2(name, 256).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    values = [[float(x) for x in r.vector] for r in chosen]
    return whole(pa.array(values, pa.list_(pa.float64())), scale)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every centroid becomes the floor of the mean of the vectors nearest to it.

    The tree travels as a broadcast of k centroids. Every task adds up its own vectors and
    sends one row per centroid it met; k x dim sums reach the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def add_up(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        total = np.zeros(tree.points.shape, np.int64)
        count = np.zeros(len(tree.points), np.int64)
        for _, q in _batches(stream, scale):
            who, _ = tree.nearest(q)
            order = np.argsort(who, kind="stable")
            met, starts, n = np.unique(who[order], return_index=True, return_counts=True)
            if len(met):
                total[met] += np.add.reduceat(q[order], starts, axis=0)
                count[met] += n
        met = np.flatnonzero(count)
        sums = pa.array(list(total[met]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), sums], ["c", "n", "sums"])

    parts = rows.mapInArrow(add_up, "c bigint, n bigint, sums array<bigint>")
    merged = parts.select("c", "n", F.posexplode("sums").alias("i", "x")).groupBy("c", "i").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in merged.collect():
        out[r.c, r.i] = r.x // r.n
    shared.unpersist()
    return out


def grouped(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            seed: str = "2", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector.

    Vectors count when they have exactly `dim` components, none null or non-finite; other
    rows are left out. Components become floor(scale * x), and all that follows is exact:
    centroids start at the k vectors of smallest hash, each round assigns every vector to
    the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves
    centroids to the floor of the mean; empty ones stay. A last assignment gives the result.

    Fewer vectors than k make as many centroids; equal vectors make equal centroids, of
    which the first gets all. Rows that repeat an id are returned as often; a null id hashes
    as an empty one. No usable vector, no rows. Scaled components beyond 2^27 are an error,
    since their squared distance would not fit its type.
    """
    spark = vectors.sparkSession
    with_package(spark)
    rows = written(usable(vectors, row_id, vector, dim), "centroid-vectors")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance bigint"
    centroids = first_centroids(rows, k, scale, seed)
    if not len(centroids):
        found, centroids = spark.createDataFrame([], schema), np.empty((0, dim), np.int64)
    else:
        for _ in range(rounds):
            before, centroids = centroids, moved(rows, centroids, scale)
            if np.array_equal(before, centroids):
                break  # further rounds would change nothing
        shared = spark.sparkContext.broadcast(VantageTree(centroids))

        def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, q in _batches(stream, scale):
                who, d2 = shared.value.nearest(q)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(who.astype(np.int32)), pa.array(d2)], ["id", "cluster", "distance"])

        found = written(rows.mapInArrow(assign, schema), "centroid-members")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "c int, centroid_sha256 string")
    sums = found.groupBy(F.col("cluster").alias("c")).agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.join(names, "c")
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    sums = sums.withColumn("inertia", F.lit(total).cast("bigint"))
    return found.join(F.broadcast(sums), F.col("cluster") == F.col("c")).select(  # k rows
        F.col("id").alias(row_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
