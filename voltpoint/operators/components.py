"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpoint.sources.scratch import written


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1] or 0


def _least(pairs: DataFrame) -> DataFrame:
    """Every ``a`` with the smallest node among itself and its ``b``."""
    return pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest neighbour of each node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.join(_least(both), F.col("a") == F.col("node")).where(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours move to the smallest neighbour of each node."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``(a, b)`` edges that is not itself the
    smallest of its component, ``root`` being that smallest node.

    Alternates two steps that keep components and turn each into a star; each
    step is an aggregate and a join with one row for a node, so a node with very
    many edges is split by adaptive execution. Rounds grow with the logarithm of
    a component's size. Each round is written, so a lost executor costs one
    round at most."""
    stars = written(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while (state := _state(stars)) != before:
        before = state
        stars = written(_small_star(_large_star(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
