"""Connected components over an edge list that never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist

#: Edges that one task joins by itself, at most (16 bytes each); more go through rounds over the cluster.
TASK_EDGES = 500_000


class Forest:
    """Sets of numbers below ``n`` that links have joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links that joined two sets."""
        out = []
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            for x, y in pairs.tolist():
                p, q = self.find(x), self.find(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    out.append((x, y))
        return out

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = persist(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = persist(edges.groupBy("hi").agg(F.min("lo").alias("m")))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    kept = least.select("hi", F.col("m").alias("lo"))
    return moved.union(kept).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of few edges ``(hi, lo)``: one task reads them all and deals the nodes out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
            node, place = np.unique(np.concatenate([hi, lo]), return_inverse=True)  # ascending, so the smallest is the root
            forest = Forest(len(node))
            forest.link(place[: len(hi)], place[len(hi) :])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[forest.labels()])], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long").repartition("node")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge: root is the smallest node it can reach.

    ``edges`` is checkpointed.  Up to TASK_EDGES of them are joined by one task: rounds are dozens of
    jobs, and what the driver holds for their tasks outweighs so few edges.  More of them go through
    alternating large-star and small-star rounds; each round is checkpointed, and only two sums
    come to the driver to tell when nothing moves any more.  The least neighbours are checkpointed
    before they are joined: a sum in the same stage as a join would keep Spark from splitting the
    partition of a node with very many links.  An empty edge list gives no rows.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    if links.count() <= TASK_EDGES:
        return _in_one_task(links)
    current = persist(links.distinct())
    tally = (F.count("*"), F.sum(F.hash("hi", "lo").cast("long")))
    seen = tuple(current.agg(*tally).first())
    while seen[0]:
        current = persist(_small_star(_large_star(current)))
        now = tuple(current.agg(*tally).first())
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(current.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).groupBy("node").agg(
        F.min("root").alias("root")
    )
