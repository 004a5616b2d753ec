"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import discard, ship, stored

#: Edges that one task joins: some hundred MB of a dictionary.
LOCAL = 500_000


def _large(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node near it."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    far = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them; edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition's edges with their smallest node within the partition."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x in (u, v):
                parent.setdefault(x, x)
            while parent[u] != u:
                parent[u] = u = parent[parent[u]]
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    roots = []
    for x in nodes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        roots.append(x)
    for a in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 100_000], pa.int64()), pa.array(roots[a : a + 100_000], pa.int64())], names=["u", "v"])


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """node and component (its smallest reachable node) of every node of links (u, v).

    Up to `local` edges are one task's work. More are first replaced by the stars of parts of that size, then by
    alternating large-star and small-star rounds, until they are few enough or no longer change. The rounds grow
    with the logarithm of the longest path. Each is written to the shared folder, so a lost executor costs one
    round. Nodes without links are not in the result.
    """
    ship(links.sparkSession)
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    edges, seen = stored(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= local:
            return edges.coalesce(1).mapInArrow(_forest, "node long, component long")
        if state == seen:
            heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
        seen = state
        parts = edges.repartition(-(-state[0] // local)).mapInArrow(_forest, "u long, v long").filter("u <> v")
        after = stored(_small(_large(parts)), "links")
        discard(edges)
        edges = after
