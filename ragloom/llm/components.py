"""Connected components by alternating large-star and small-star rounds, as joins and grouped minima.

Edges stay a distributed table throughout; each round ends in a reliable checkpoint. A node of many edges is no group
that must be gathered: minima are pre-aggregated before the shuffle. The minima join back by a broadcast while the
edges are counted to be few; else by a shuffle join with a plain exchange on either side, so that adaptive execution
can split a hot node's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges up to which the minima (16 bytes each, fewer than edges) are broadcast, and edges in a partition.
BROADCAST_EDGES, PARTITION_EDGES = 100_000, 20_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """For rows (u, v): u, v, and the least v of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # an exchange between, so that either side of the join has a plain one; by both columns, as a component's nodes share m
    return edges.join(F.broadcast(least) if small else least.repartition("u", "m"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge; edges: two id columns of one type; component: the least node reached.

    Loops, repeated and reversed edges, and rows with a null are allowed and change nothing (nodes that only have a
    loop or a null are left out). No edges: no rows.
    """
    a, b = (F.col(c) for c in edges.columns)
    current = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    # no round makes more edges than there are at first
    n = current.count()
    small, parts = n <= BROADCAST_EDGES, n // PARTITION_EDGES + 1
    seen = None
    while True:  # the number of components and the sum of labels fall until they settle, in about log2(longest path) rounds
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        found = _star(cut(large.distinct().coalesce(parts)), small)
        linked = found.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        current = cut(linked.unionByName(found.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
