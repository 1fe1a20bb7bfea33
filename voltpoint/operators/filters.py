"""Closed-range selection."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltpoint.schema import Thresholds

Bounds = dict[str, tuple[float | None, float | None]]


def range_condition(schema: T.StructType, bounds: Bounds) -> Column:
    """AND of ``low <= column <= high``; a NULL value fails.

    A bound on a FLOAT column is narrowed to FLOAT first, so 0.1 selects 0.1.
    Bounds are literals of the column's own width, which lets the comparison
    reach the Parquet scan.
    """
    terms = []
    for name, (low, high) in bounds.items():
        narrow = isinstance(schema[name].dataType, T.FloatType)

        def literal(value, narrow=narrow):
            return F.lit(float(value)).cast("float") if narrow else F.lit(value)

        if low is not None:
            terms.append(F.col(name) >= literal(low))
        if high is not None:
            terms.append(F.col(name) <= literal(high))
    return reduce(and_, terms, F.lit(True))


def range_filter(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.where(range_condition(df.schema, bounds))


def filter_points(points: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Points inside all thresholds (the defaults when none are given)."""
    return range_filter(points, (thresholds or Thresholds()).bounds())


def project_points(points: DataFrame) -> DataFrame:
    """The four values the views are made of."""
    return points.select("epoch_ns", "lon", "lat", "alt")
