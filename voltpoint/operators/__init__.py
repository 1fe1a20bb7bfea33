"""Selection, extents, panels, rasters and colours over point frames."""

from voltpoint.operators.components import components
from voltpoint.operators.cube import cube_counts, threshold_cube
from voltpoint.operators.extents import (
    attach_extent,
    axis_ticks,
    axis_ticks_3,
    axis_ticks_5,
    extent,
    extent_fields,
    extent_per_row,
    finite,
    panel_extent,
    point_extent,
)
from voltpoint.operators.filters import filter_points, project_points, range_condition, range_filter
from voltpoint.operators.flashes import flash_groups, flash_summary
from voltpoint.operators.palette import apply_palette
from voltpoint.operators.panels import normalize_time, panel, panels, relative_time
from voltpoint.operators.raster import (
    alt_histogram,
    cell,
    grid,
    histogram,
    raster,
    raster_frames,
    rasters,
)

__all__ = [
    "alt_histogram",
    "apply_palette",
    "attach_extent",
    "axis_ticks",
    "axis_ticks_3",
    "axis_ticks_5",
    "cell",
    "components",
    "cube_counts",
    "extent",
    "extent_fields",
    "extent_per_row",
    "filter_points",
    "finite",
    "flash_groups",
    "flash_summary",
    "grid",
    "histogram",
    "normalize_time",
    "panel",
    "panel_extent",
    "panels",
    "point_extent",
    "project_points",
    "range_condition",
    "range_filter",
    "raster",
    "raster_frames",
    "rasters",
    "relative_time",
    "threshold_cube",
]
