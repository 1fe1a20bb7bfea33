"""Relative time, normalised colour value and the four 2-D panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpoint.functions.parse import difference, exact_difference
from voltpoint.operators.extents import EXTENT, attach_extent, extent_fields, finite, point_extent
from voltpoint.schema import PANELS


def rel_ns() -> Column:
    """Nanoseconds since the earliest point, of a frame with its extent attached;
    NULL where they are beyond 64 bits."""
    return exact_difference(F.col("epoch_ns"), F.col(f"{EXTENT}.t_min_ns"))


def elapsed() -> Column:
    """The same as DOUBLE, which has no such limit."""
    return difference(F.col("epoch_ns"), F.col(f"{EXTENT}.t_min_ns"))


def span() -> Column:
    """DOUBLE nanoseconds from the earliest point to the latest."""
    return difference(F.col(f"{EXTENT}.t_max_ns"), F.col(f"{EXTENT}.t_min_ns"))


def color_value() -> Column:
    """0 at the earliest point, 1 at the latest, of a frame with its extent attached."""
    # NULL, not infinity, when all points share one time.
    return elapsed() / F.nullif(span(), F.lit(0.0))


def relative_time(points: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """Adds exact ``rel_ns`` and single-precision ``t``, both counted from the
    earliest point."""
    extents = point_extent(points) if extents is None else extents
    return attach_extent(points, extents, ["t_min_ns"]).select(
        *points.columns, rel_ns().alias("rel_ns"), elapsed().cast("float").alias("t")
    )


def normalize_time(points: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """Adds ``color``: 0 at the earliest point, 1 at the latest."""
    extents = point_extent(points) if extents is None else extents
    attached = attach_extent(points, extents, extent_fields("time"))
    return attached.select(*points.columns, color_value().alias("color"))


def _axis(points: DataFrame, axis: str) -> Column:
    return elapsed().cast("float") if axis == "time" else finite(points, axis)


def panel(points: DataFrame, name: str, extents: DataFrame | None = None) -> DataFrame:
    """``(x, y, color)`` of one panel; points without a coordinate are left out."""
    extents = point_extent(points) if extents is None else extents
    x, y = PANELS[name]
    return (
        attach_extent(points, extents, extent_fields("time"))
        .select(_axis(points, x).alias("x"), _axis(points, y).alias("y"), color_value().alias("color"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def panels(points: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """``(panel, x, y, color)`` of all panels from a single pass over the points."""
    extents = point_extent(points) if extents is None else extents
    views = [
        F.struct(F.lit(name).alias("panel"), _axis(points, x).alias("x"), _axis(points, y).alias("y"))
        for name, (x, y) in PANELS.items()
    ]
    return (
        attach_extent(points, extents, extent_fields("time"))
        .select(F.inline(F.array(*views)), color_value().alias("color"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
