"""Connected components of a graph too large for one machine: alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import new_path, remove

#: Stars double the reach of every node, so that even a path of 2^50 nodes ends before this.
MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs in any order -> (node, component), component being the smallest node reached.

    Nodes without edges don't appear; loops, repeated edges and null ends are ignored. All sums are made by Spark; the
    driver sees two numbers a round. A node with many neighbours is a skewed join key, which AQE splits. A round's table
    is removed as soon as the next one is written; the last one stays.
    """
    spark = edges.sparkSession
    folder = new_path(spark, "edges")
    edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(folder)
    edges = spark.read.schema("u long, v long").parquet(folder)
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        before, folder = folder, new_path(spark, "stars")
        _small(_large(edges)).write.parquet(folder)
        edges = spark.read.schema("u long, v long").parquet(folder)
        remove(spark, before)
    else:
        raise RuntimeError("components did not settle")
    least = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return least.union(edges.select("v", "v").distinct())


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links u-v held in one task: the smallest node reached by each."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new != new[new]).any():
            new = new[new]
        root = new
        left = root[u] != root[v]
        u, v = u[left], v[left]
    return root
