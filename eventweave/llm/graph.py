"""Connected components of large graphs, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.llm.scratch import discard, materialize

#: Nodes that can have so large a part of the edges that their minima are broadcast.
HUBS = 1000


def smallest_reached(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest of n places that each reaches by the edges (left, right)."""
    name = np.arange(n)
    while True:
        least = np.minimum(name[left], name[right])
        after = name.copy()
        np.minimum.at(after, left, least)
        np.minimum.at(after, right, least)
        np.minimum.at(after, name[left], least)
        np.minimum.at(after, name[right], least)
        after = after[after]
        if (after == name).all():
            return name
        name = after


def _nearer(pairs: DataFrame, many: int) -> DataFrame:
    """Pairs (u, v), each with m, the smallest of u and all its v.

    Minima of nodes with more than ``many`` pairs are broadcast, since those pairs would meet in one task; there are few of them.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > many).select("u", F.col("m").alias("hub")))
    known = pairs.join(hubs, "u", "left")
    rest = known.where("hub is null").select("u", "v").join(least.where(F.col("n") <= many).select("u", "m"), "u")
    return rest.unionByName(known.where("hub is not null").select("u", "v", F.col("hub").alias("m"))).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearer(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearer(down, many)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to its component's smallest node: no node has two edges up, or edges up and down."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b) but the components' smallest ones; component is the smallest node reached.

    Every round aggregates minima before it joins them. A node with more than 1 / HUBS of the edges is a hub; its minimum is
    broadcast to its edges, at most 3 * HUBS rows of 16 bytes at any size, so its edges are never gathered in a task. Rounds are
    written to the shared folder, and the number of rounds grows with the logarithm of the graph's size. Edges that already lead to the smallest
    nodes take no round. Edges with a null end are ignored.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), tag)
    many = max(64, now.count() // HUBS)
    while not _settled(now):
        half = materialize(_large_star(now, many), tag)
        then = materialize(_small_star(half, many), tag)
        discard(half)
        discard(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
