"""Points on a pixel grid, histograms and frames.

All are hash aggregates whose number of groups is the grid size, whatever the
number of points: tasks combine their own rows first, so a crowded cell is a
handful of partial counts at the shuffle. A cell is one integer while it is
grouped and shuffled, and its coordinates are worked out afterwards.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpoint.operators.extents import EXTENT, attach_extent, extent, extent_fields, finite, point_extent
from voltpoint.operators.panels import color_value, elapsed, span
from voltpoint.schema import PANELS


def cell(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Index of ``value`` in ``cells`` equal parts of [low, high].

    The upper edge belongs to the last cell; a range of no width has one cell;
    a value outside the range has none."""
    value, low, high = value.cast("double"), low.cast("double"), high.cast("double")
    place = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * cells)
    # least() skips NULLs, so the NULL of an empty range is replaced before it.
    index = F.least(F.lit(cells - 1).cast("bigint"), F.coalesce(place, F.lit(0).cast("bigint")))
    return F.when(value.between(low, high), index)


def _pack(indices: list[tuple[Column, int]]) -> Column:
    """One number for several (index, size); NULL when an index is."""
    key = F.lit(0).cast("bigint")
    for index, size in indices:
        key = key * F.lit(size) + index
    return key


def _unpack(key: Column, sizes: dict[str, int]) -> list[Column]:
    columns = []
    for name, size in reversed(sizes.items()):
        columns.insert(0, F.pmod(key, F.lit(size)).cast("int").alias(name))
        key = F.call_function("div", key, F.lit(size))
    return columns


def _bounds(name: str) -> tuple[Column, Column]:
    return F.col(f"{EXTENT}.{name}_min"), F.col(f"{EXTENT}.{name}_max")


def _inside(cells: DataFrame, name: str, given: bool) -> DataFrame:
    # Nothing lies outside the rows' own extent, so that test is saved.
    return cells.where(F.col(name).isNotNull()) if given else cells


def _with_values(df: DataFrame, columns: list[str]) -> DataFrame:
    # Tested on the columns, not on the cell, which would be worked out twice.
    return df.where(reduce(and_, [finite(df, name).isNotNull() for name in columns]))


def grid(
    df: DataFrame, x: str, y: str, width: int, height: int, *, latest: str, extents: DataFrame | None = None
) -> DataFrame:
    """``(px, py, last, n)`` of any frame with two numeric columns: the number
    of rows in a cell and the greatest value of the ``latest`` column. Rows
    outside a given extent are left out."""
    given, extents = extents is not None, extent(df, [x, y]) if extents is None else extents
    px = cell(finite(df, x), *_bounds(x), width)
    py = cell(finite(df, y), *_bounds(y), height)
    cells = attach_extent(_with_values(df, [x, y]), extents, [f"{c}_{side}" for c in (x, y) for side in ("min", "max")])
    cells = cells.select(_pack([(px, width), (py, height)]).alias("cell"), F.col(latest).alias("latest"))
    return (
        _inside(cells, "cell", given)
        .groupBy("cell")
        .agg(F.max("latest").alias("last"), F.count("*").alias("n"))
        .select(*_unpack(F.col("cell"), {"px": width, "py": height}), "last", "n")
    )


def _axis_cell(points: DataFrame, axis: str, cells: int) -> Column:
    if axis == "time":
        return cell(elapsed(), F.lit(0.0), span(), cells)
    return cell(finite(points, axis), *_bounds(axis), cells)


def _latest_wins(cells: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(cell, epoch_ns, color)`` -> ``(<sizes>, last_ns, n, color)`` per cell.

    The colour value grows with time, so its maximum is the latest point's."""
    return (
        cells.groupBy("cell")
        .agg(
            F.max("epoch_ns").alias("last_ns"),
            F.count("*").alias("n"),
            F.max("color").alias("color"),
        )
        .select(*_unpack(F.col("cell"), sizes), "last_ns", "n", "color")
    )


def _axis_cells(points: DataFrame, extents: DataFrame, axes: dict[str, tuple[str, int]]) -> DataFrame:
    """Column name -> (axis, cells), beside time and colour value."""
    fields = extent_fields("time", *[axis for axis, _ in axes.values()])
    return attach_extent(points, extents, fields).select(
        *[_axis_cell(points, axis, n).alias(name) for name, (axis, n) in axes.items()],
        "epoch_ns",
        color_value().alias("color"),
    )


def _one_panel(
    points: DataFrame, extents: DataFrame | None, axes: dict[str, tuple[str, int]]
) -> DataFrame:
    given, extents = extents is not None, point_extent(points) if extents is None else extents
    columns = ["epoch_ns" if axis == "time" else axis for axis, _ in axes.values()]
    key = _pack([(F.col(name), n) for name, (_, n) in axes.items()])
    cells = _axis_cells(_with_values(points, columns), extents, axes)
    sizes = {name: n for name, (_, n) in axes.items()}
    return _latest_wins(_inside(cells.select(key.alias("cell"), "epoch_ns", "color"), "cell", given), sizes)


def raster(
    points: DataFrame, panel: str, width: int, height: int, extents: DataFrame | None = None
) -> DataFrame:
    """``(px, py, last_ns, n, color)`` per non-empty cell of one panel.

    The latest point colours the cell; y grows upward. Points outside a given
    extent are left out."""
    x, y = PANELS[panel]
    return _one_panel(points, extents, {"px": (x, width), "py": (y, height)})


def rasters(points: DataFrame, width: int, height: int, extents: DataFrame | None = None) -> DataFrame:
    """`raster` of all panels from a single pass, with a ``panel`` column."""
    extents = point_extent(points) if extents is None else extents
    # Several panels share an axis, so each axis is cut into cells once.
    axes = {f"px_{x}": (x, width) for x, _ in PANELS.values()}
    axes |= {f"py_{y}": (y, height) for _, y in PANELS.values()}
    keys = [
        _pack([(F.lit(i), len(PANELS)), (F.col(f"px_{x}"), width), (F.col(f"py_{y}"), height)])
        for i, (x, y) in enumerate(PANELS.values())
    ]
    cells = _axis_cells(points, extents, axes).select(
        F.explode(F.array(*keys)).alias("cell"), "epoch_ns", "color"
    )
    names = F.array(*[F.lit(name) for name in PANELS])
    return _latest_wins(
        cells.where(F.col("cell").isNotNull()), {"panel": len(PANELS), "px": width, "py": height}
    ).withColumn("panel", F.get(names, F.col("panel")))


def raster_frames(
    points: DataFrame, panel: str, width: int, height: int, frames: int, extents: DataFrame | None = None
) -> DataFrame:
    """`raster` per time frame, the selection's span cut into equal ``frames``."""
    x, y = PANELS[panel]
    axes = {"frame": ("time", frames), "px": (x, width), "py": (y, height)}
    return _one_panel(points, extents, axes)


def histogram(df: DataFrame, column: str, bins: int, extents: DataFrame | None = None) -> DataFrame:
    """``(bin, n)`` per non-empty bin of equal width between minimum and maximum;
    values outside a given extent are left out."""
    given, extents = extents is not None, extent(df, [column]) if extents is None else extents
    cells = attach_extent(_with_values(df, [column]), extents, [f"{column}_min", f"{column}_max"])
    cells = cells.select(cell(finite(df, column), *_bounds(column), bins).cast("int").alias("bin"))
    return (
        _inside(cells, "bin", given)
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def alt_histogram(points: DataFrame, bins: int = 20, extents: DataFrame | None = None) -> DataFrame:
    return histogram(points, "alt", bins, extents)
