"""Connected components of an edge table: union-find inside each partition, then star contraction across partitions.

All state stays in tables; a node of any degree is met by partial aggregation and by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import discard, written


#: Edges of a partition that wait before they are put together with what it holds.
WAITING = 1 << 18


def roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over parallel arrays of node ids: the distinct nodes and the smallest node that each can reach.

    All edges at once: the larger root of each edge is hung below the smallest root that it meets, paths are halved until every
    node points to a root, and edges inside one tree are dropped. Each round leaves a part of the edges."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = at[: len(src)], at[len(src) :]
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return nodes, nodes[parent]


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of which each partition keeps a spanning star of what it holds, u > v.

    Batches wait until they are as many edges as the star so far, so that each edge is gone through a few times, not once for
    every later batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[pa.RecordBatch] = []
        count = 0

        def united() -> tuple[np.ndarray, np.ndarray]:
            nodes, root = roots(np.concatenate([u, *(b.column(0).to_numpy() for b in waiting)]), np.concatenate([v, *(b.column(1).to_numpy() for b in waiting)]))
            return nodes[nodes != root], root[nodes != root]

        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= max(WAITING, len(u)):
                u, v = united()
                waiting, count = [], 0
        if waiting:
            u, v = united()
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node that it can reach.

    Null ends are left out, an edge of a node with itself only names the node, repeated edges count once, no edges give
    no rows. Each round moves every node to the smallest neighbour of its neighbours (pointer jumping), so the number of
    rounds grows with the logarithm of the longest chain.
    """
    clean = written(edges.where("u is not null and v is not null").select("u", "v"))
    loose = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    # partitions are contracted as they come: edges that are dealt by place are mostly settled here
    star = written(contract(clean.where("u != v")).distinct())
    while True:
        # large star: every neighbour of a node that is above it, and the node, go to the smallest of them
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below a node, and the node, go to the smallest of them
        below = large.where("u > v")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        moved = below.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, star = star, written(contract(moved).distinct())
        discard(before)
        # done when no node has two parents and no parent is itself below another node: one pass over the ends
        ends = star.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(star.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
        if seen.where("up > 1 OR (up > 0 AND top > 0)").isEmpty():
            break
    linked = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    alone = loose.join(linked.select("node").unionByName(tops.select("node")), "node", "left_anti").select("node", F.col("node").alias("root"))
    return linked.unionByName(tops).unionByName(alone)
