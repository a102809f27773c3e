"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash


class Union:
    """Components of what one task has seen; the root of each is its smallest node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as (root, node), batch by batch."""
    for batch in batches:
        seen = Union()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.join(a, b)
        nodes = list(seen.parent)
        yield pa.RecordBatch.from_arrays([pa.array([seen.find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (a, b) with a < b.  Only minima are grouped, so a hub is summed before the shuffle."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    side = both.where("v > u") if large else both.where("v < u")
    out = side.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.union(low.where("m < u").select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; the component is its smallest node."""
    edges = stash(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    mark = None
    while True:
        edges = stash(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = tuple(now)
