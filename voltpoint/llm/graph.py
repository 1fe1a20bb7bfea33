"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpoint.llm.common import staged


def _with_smallest(edges: DataFrame) -> DataFrame:
    """``a, b, m`` where m is the smallest of a and its neighbours. The minima
    are written first, so that a hub's rows meet them in a join that adaptive
    execution can split."""
    smallest = staged(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "smallest")
    return edges.join(smallest, "a")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge hangs a leaf below a centre: no node hangs twice, and
    nothing hangs below one that hangs itself. Edges are distinct."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the
    edges ``a, b``; loops and repeated edges do no harm, and none give none.

    Alternates large-star and small-star steps until only stars are left: each
    hangs neighbours below the smallest node known, in a number of rounds that
    grows with the logarithm of the graph. Each round is written to the shared
    folder."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        small = _with_smallest(large)
        hung = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(hung.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
