"""Union-find over a distributed edge list: every node gets the smallest node it is connected with."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.session import durable, release

#: A task hands on its local forest when it holds so many nodes; so many edges are finished by one task.
FOREST_NODES = 250_000


class Forest(dict):
    """Local union-find: the root of a set is its smallest member."""

    def root(self, x: int) -> int:
        while (above := self.setdefault(x, x)) != x:
            self[x] = x = self[above]
        return x

    def unite(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each task as a forest: every node with its root, so that chains within a task are gone at once."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in list(forest) if (r := forest.root(x)) != x]
        forest.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.unite(u, v)
        if len(forest) > 2 * FOREST_NODES:
            yield out()
    yield out()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, component)` for every node of `edges`; component is the smallest node reachable. Nulls are left out.

    Each task first contracts its own edges. Then two steps alternate until nothing
    changes: every node's larger neighbours are hung on its smallest neighbour, then its
    smaller neighbours are. Both keep the components as they are and shorten paths to
    one step within a logarithmic number of rounds. Only counts reach the driver; each
    round is written to the shared folder and the round before deleted. A node with
    very many neighbours is a skewed join key, which adaptive execution splits, as both
    sides of the join are plain exchanges of stored tables. Where the contracted edges
    fit one task, as a bound says, that task ends the work instead of the rounds.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = durable(edges.mapInArrow(_contracted, "u long, v long"))
    if edges.count() <= FOREST_NODES:
        whole = durable(edges.coalesce(1).mapInArrow(_contracted, "u long, v long"))
        release(edges)
        return _labelled(whole)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        shorter = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(edges, large)
        edges = shorter
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return _labelled(edges)


def _labelled(stars: DataFrame) -> DataFrame:
    """Nodes and their components from edges that all lead to the smallest node."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
