"""What several operators share: tables in the shared folder, connected components."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.session import shared_dir

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def with_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the caller's path does not name it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)


def at_least(df: DataFrame, n: int | None = None) -> DataFrame:
    """Spread a scan with fewer splits than the cluster has cores; otherwise unchanged.

    Never more than that: the rows of a large table stay where they are.
    """
    cores = n or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root: the smallest node reachable.

    Alternates large-star and small-star: every round each node tells its neighbours the
    smallest node it knows. Edges only, minima are combined before the shuffle, rounds
    are cut by checkpoints, and the loop ends when a round changes nothing. A node of very
    many edges is split by Spark's skew join. Nulls and loops must not occur in `edges`.
    """
    shared_dir(edges.sparkSession)

    def star(e: DataFrame, larger_only: bool) -> DataFrame:
        ends = e if larger_only else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = ends.join(low, ends["a"] == low["k"])
        if larger_only:  # all smaller neighbours, and the node itself, point to the smallest
            pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
            out = out.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
        else:  # larger neighbours point to the smallest
            out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = e.checkpoint()
    seen = mark(e)
    for _ in range(max_rounds):
        e = star(star(e, False), True).checkpoint()
        now = mark(e)
        if now == seen:
            roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = now
    raise RuntimeError("components did not settle")


class Forest:
    """Components of the n members of one bounded block."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        """All `members` belong together. Roots always point at the smallest member."""
        tops = self.find(members)
        low = tops.min()
        self.root[tops] = low
        self.root[members] = low

    def find(self, members: np.ndarray) -> np.ndarray:
        up = self.root[members]
        while True:
            nxt = self.root[up]
            if np.array_equal(nxt, up):
                return up
            up = nxt

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.root)))
