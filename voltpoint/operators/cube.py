"""Counts for many threshold sets from one cube of binned columns.

Columns are cut at given edges; the cube has the number of rows of every
combination of bins. A threshold set takes bins as a whole, leaves them out, or
cuts through them. Whole bins are summed up from the cube; only the rows of bins
that a threshold cuts are looked at again, so counts are exact everywhere and
take no rows at all where thresholds lie at edges.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltpoint.operators.filters import Bounds
from voltpoint.schema import Thresholds

Edges = dict[str, list[float]]


def _bin(value: Column, edges: list[float]) -> Column:
    """The number of edges at or below a value; NULL and NaN have no bin."""
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(value.isNotNull() & ~F.isnan(value), F.size(F.filter(cuts, lambda e: e <= value)))


def _binned(df: DataFrame, edges: Edges) -> DataFrame:
    values = {c: F.col(c).cast("double") for c in edges}
    found = df.select(*[v.alias(c) for c, v in values.items()], *[_bin(v, edges[c]).alias(f"bin_{c}") for c, v in values.items()])
    return found.where(reduce(and_, [F.col(f"bin_{c}").isNotNull() for c in edges]))


def threshold_cube(df: DataFrame, edges: Edges) -> DataFrame:
    """``bin_<column>..., n`` with a row for each combination that occurs, and the
    least and greatest value of each column in it. At most the product of
    (edges + 1) rows, whatever the number of rows of ``df``."""
    sides = [f(c).alias(f"{name}_{c}") for c in edges for name, f in (("low", F.min), ("high", F.max))]
    return _binned(df, edges).groupBy(*[f"bin_{c}" for c in edges]).agg(F.count("*").alias("n"), *sides)


def _sets(df: DataFrame, edges: Edges, sets: dict[str, Bounds]) -> DataFrame:
    rows = []
    for name, bounds in sets.items():
        unknown = set(bounds) - set(edges)
        if unknown:
            raise ValueError(f"the cube has no edges for {sorted(unknown)}")
        row = [name]
        for column in edges:
            low, high = bounds.get(column, (None, None))
            narrow = isinstance(df.schema[column].dataType, T.FloatType)
            row += [None if v is None else _single(v) if narrow else float(v) for v in (low, high)]
        rows.append(tuple(row))
    names = ", ".join(f"from_{c} double, to_{c} double" for c in edges)
    return df.sparkSession.createDataFrame(rows, f"thresholds string, {names}")


def _single(value: float) -> float:
    import numpy as np

    return float(np.float32(value))


def _inside(low: Column, high: Column, column: str) -> Column:
    """Whether all of low..high lies within a set's bounds."""
    first, last = F.col(f"from_{column}"), F.col(f"to_{column}")
    return (first.isNull() | (low >= first)) & (last.isNull() | (high <= last))


def _touched(column: str) -> Column:
    first, last = F.col(f"from_{column}"), F.col(f"to_{column}")
    return (first.isNull() | (F.col(f"high_{column}") >= first)) & (last.isNull() | (F.col(f"low_{column}") <= last))


def cube_counts(df: DataFrame, cube: DataFrame, edges: Edges, sets: dict[str, Bounds] | dict[str, Thresholds]) -> DataFrame:
    """``thresholds, n``: the rows of ``df`` inside each set of closed bounds.

    ``df`` is read once for all sets, and only where a set cuts a bin."""
    plain = {name: s.bounds() if isinstance(s, Thresholds) else s for name, s in sets.items()}
    asked = _sets(df, edges, plain)
    # Both sides are small by their nature: sets that a caller wrote, bins of a cube.
    pairs = cube.join(F.broadcast(asked), reduce(and_, [_touched(c) for c in edges]))
    whole = reduce(and_, [_inside(F.col(f"low_{c}"), F.col(f"high_{c}"), c) for c in edges])
    pairs = pairs.withColumn("whole", whole)
    sums = pairs.where("whole").groupBy("thresholds").agg(F.sum("n").alias("n"))
    bins = [f"bin_{c}" for c in edges]
    cut = pairs.where(~F.col("whole")).select("thresholds", *bins, *[f"{s}_{c}" for c in edges for s in ("from", "to")])
    rows = _binned(df, edges).join(cut, bins)
    rows = rows.where(reduce(and_, [_inside(F.col(c), F.col(c), c) for c in edges]))
    looked = rows.groupBy("thresholds").agg(F.count("*").alias("n"))
    both = sums.unionByName(looked).groupBy("thresholds").agg(F.sum("n").alias("n"))
    return asked.select("thresholds").join(both, "thresholds", "left").select("thresholds", F.coalesce("n", F.lit(0)).alias("n"))
