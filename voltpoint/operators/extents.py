"""Global minima and maxima, and the axes derived from them.

An unpartitioned window would bring every row to one task. The extent is an
aggregate instead (partial per task, one final row) and reaches the rows as a
scalar subquery, i.e. as a constant: no join, no shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltpoint.functions.parse import difference, exact_difference, fixed_decimals
from voltpoint.schema import EXTENT_PANELS, TICK_FIRST, TICKS_3, TICKS_5

EXTENT = "_extent"


def finite(df: DataFrame, name: str) -> Column:
    """The column without NaN and infinities, which sort above every number,
    and without negative zero, which is equal to zero but not the same value."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.col(name) + F.lit(0.0).cast(kind)
        return F.when(F.abs(F.col(name)) < F.lit(float("inf")), value)
    return F.col(name)


def extent(df: DataFrame, columns: list[str], *, count: str = "row_count") -> DataFrame:
    """One row: number of rows, and ``<column>_min`` / ``<column>_max``.

    NULLs are ignored; an empty input gives a count of 0 and NULL bounds."""
    bounds = []
    for name in columns:
        value = finite(df, name)
        bounds += [F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    return df.agg(F.count("*").alias(count), *bounds)


def point_extent(points: DataFrame) -> DataFrame:
    """One row ``(source_count, t_min_ns, t_max_ns, span_ns, lon_min, ...)``.

    ``span_ns`` is NULL where it is beyond 64 bits."""
    raw = extent(points, ["epoch_ns", "lon", "lat", "alt"], count="source_count")
    return raw.select(
        "source_count",
        F.col("epoch_ns_min").alias("t_min_ns"),
        F.col("epoch_ns_max").alias("t_max_ns"),
        exact_difference(F.col("epoch_ns_max"), F.col("epoch_ns_min")).alias("span_ns"),
        "lon_min",
        "lon_max",
        "lat_min",
        "lat_max",
        "alt_min",
        "alt_max",
    )


def attach_extent(df: DataFrame, extents: DataFrame, fields: list[str]) -> DataFrame:
    """Every row of ``df`` with the named fields of the one row of ``extents`` as
    a struct; the others are not worked out, nor their columns read."""
    row = extents.select(F.struct(*fields)).scalar()
    return df.select("*", row.alias(EXTENT))


def extent_fields(*axes: str) -> list[str]:
    """The fields of `point_extent` that these axes need; "time" needs both ends."""
    names = {"time": ["t_min_ns", "t_max_ns"]}
    return [f for axis in dict.fromkeys(axes) for f in names.get(axis, [f"{axis}_min", f"{axis}_max"])]


def extent_per_row(points: DataFrame) -> DataFrame:
    """Relative time and coordinates of each point beside the global bounds."""
    bounds = extent_fields("time", "lon", "lat", "alt")
    return attach_extent(points, point_extent(points), bounds).select(
        difference(F.col("epoch_ns"), F.col(f"{EXTENT}.t_min_ns")).cast("float").alias("t"),
        "lon",
        "lat",
        "alt",
        *[F.col(f"{EXTENT}.{b}").alias(b) for b in bounds],
    )


def _axis_bounds(axis: str | None) -> tuple[Column, Column]:
    # The time axis is relative to the earliest point.
    if axis is None:
        return F.lit(None).cast("float"), F.lit(None).cast("float")
    if axis == "time":
        span = difference(F.col("t_max_ns"), F.col("t_min_ns"))
        return F.when(span.isNotNull(), F.lit(0.0)).cast("float"), span.cast("float")
    return F.col(f"{axis}_min"), F.col(f"{axis}_max")


def panel_extent(extents: DataFrame) -> DataFrame:
    """One row ``(panel, x_min, x_max, y_min, y_max)`` per panel."""
    rows = []
    for panel, (x, y) in EXTENT_PANELS.items():
        (x_min, x_max), (y_min, y_max) = _axis_bounds(x), _axis_bounds(y)
        rows.append(
            F.struct(
                F.lit(panel).alias("panel"),
                x_min.alias("x_min"),
                x_max.alias("x_max"),
                y_min.alias("y_min"),
                y_max.alias("y_max"),
            )
        )
    return extents.select(F.inline(F.array(*rows)))


def axis_ticks(extents: DataFrame, ticks: int) -> DataFrame:
    """``(panel, axis, i, fraction, value, label)`` of all axes with that many
    ticks: altitude axes have three, the others five.

    Arithmetic is single precision, as the labels show its digits."""
    if ticks not in (3, 5):
        raise ValueError("an axis has 3 or 5 ticks")
    spec = TICKS_3 if ticks == 3 else TICKS_5
    axes = []
    for panel, sides in EXTENT_PANELS.items():
        for side, axis in zip("xy", sides):
            if axis is None or (axis == "alt") != (ticks == 3):
                continue
            low, high = _axis_bounds(axis)
            axes.append(
                F.struct(
                    F.lit(panel).alias("panel"),
                    F.lit(side).alias("axis"),
                    low.alias("low"),
                    high.alias("high"),
                )
            )
    step = F.col("i").cast("float") * F.lit(spec["step"]).cast("float")
    return (
        extents.select(F.inline(F.array(*axes)))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(spec["count"] - 1))).alias("i"))
        .select("*", (F.lit(TICK_FIRST).cast("float") + step).alias("fraction"))
        .select(
            "panel",
            "axis",
            "i",
            "fraction",
            (F.col("low") + F.col("fraction") * (F.col("high") - F.col("low"))).alias("value"),
        )
        .select("*", fixed_decimals(F.col("value")).alias("label"))
    )


def axis_ticks_5(extents: DataFrame) -> DataFrame:
    return axis_ticks(extents, 5)


def axis_ticks_3(extents: DataFrame) -> DataFrame:
    return axis_ticks(extents, 3)
