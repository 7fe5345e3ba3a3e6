"""Connected components of a graph given by its edges, by spreading the smallest node and jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hot_join, hot_keys, stored


class Forest:
    """Union-find; the smallest member leads."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = self.up[min(a, b)] = min(a, b)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each partition replaces its own by a star around each of its smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        nodes = [x for x in forest.up if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([forest.find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (its smallest node) for every node of an edge.

    Each round, a node takes the smallest label around it, then its label's label. The edges of a node that has
    very many are dealt over several tasks, and minima are taken before the shuffle; nodes that share a label are narrow rows, which a skewed join may split."""
    few = stored(contracted(edges.select("a", "b").where("a <> b")), "edges")
    both = few.union(few.select("b", "a"))
    hubs = hot_keys(both, ["b"])
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], ["a"], hot=hubs).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("step"), F.col("component").alias("was"))
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("step"), F.col("step").alias("far"))
        new = stored(lower.join(jump, "step").select("node", F.least("step", "far").alias("component"), "was"), "labels")
        done = new.where("component <> was").isEmpty()
        labels = new.select("node", "component")
        if done:
            return labels
