"""Connected components as joins and minima over edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kvloom.llm.common import cut, drop_path

#: Edges that one task joins in memory (16 bytes each, some ten times that at work).
EDGES = 250_000
NODES = StructType([StructField("node", LongType()), StructField("component", LongType())])


def in_memory(batches):
    """(node, component) of at most ``EDGES`` edges (hi, lo)."""
    edges = [np.stack([b.column("hi").to_numpy(), b.column("lo").to_numpy()]) for b in batches if b.num_rows]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    sets = Sets(len(nodes))
    for x, y in at.reshape(2, -1).T.tolist():
        sets.union(x, y)
    roots = np.fromiter((sets.find(i) for i in range(len(nodes))), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a and b): the smallest node it is linked with.

    Edges are written out and counted. Up to ``EDGES`` of them, a bound that does not grow with the
    data, are joined by one task; beyond, large-star and small-star turns alternate until the edges are stars around the smallest nodes.
    Each turn takes minima with partial sums before the shuffle and joins them back from a table of
    its own, so that adaptive execution can split the join at hot nodes; no node's neighbours are gathered in one place. Each
    turn's edges are written to the shared folder, so a lost executor costs one turn at most.
    Self-links and nulls are dropped; repeated edges count once; without edges the result is empty.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = cut(e, "edges")
    if e.count() <= EDGES:
        found = cut(e.coalesce(1).mapInArrow(in_memory, NODES), "components")
        drop_path(e.sparkSession, e)
        return found
    last = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        low = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(low, "hi")
        pairs = small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        fresh = cut(pairs.distinct(), "edges")
        state = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        for used in (e, least, large, low):
            drop_path(e.sparkSession, used)
        e = fresh
        if state == last:
            break
        last = state
    members = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.unionByName(e.groupBy("lo").agg(F.lit(1).alias("one")).select(F.col("lo").alias("node"), F.col("lo").alias("component")))


class Sets:
    """Disjoint sets of the numbers below n, in one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.parent[y] = x
        return True
