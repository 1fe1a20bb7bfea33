"""The interactive flow: load files, move thresholds, look at the views."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from voltpoint import operators, sources
from voltpoint.schema import PANELS, Thresholds
from voltpoint.sources.tables import POINT_VIEW, STRIKE_VIEW


class Workspace:
    """One point table and one set of thresholds; every view follows both.

    Views are lazy frames over the same selection. Nothing is collected here:
    rasters, ticks and extents are small by their nature, points are not.
    """

    def __init__(
        self,
        spark: SparkSession,
        thresholds: Thresholds | None = None,
        *,
        view: str = POINT_VIEW,
        strikes: str | None = None,
    ) -> None:
        """``view`` names the table, ``strikes`` that of strikes (by default
        `STRIKE_VIEW`, or ``<view>_strikes`` beside another view); give each of
        several workspaces its own."""
        self.spark = spark
        self.thresholds = thresholds or Thresholds()
        self.view = view
        self.strikes = strikes or (STRIKE_VIEW if view == POINT_VIEW else f"{view}_strikes")
        self._points: DataFrame | None = None
        self._kept: DataFrame | None = None
        self._paths: sources.lylout.Paths | None = None
        self._extents: DataFrame | None = None

    def load(self, paths: sources.lylout.Paths, *, stage_to: str | None = None) -> DataFrame:
        """Replace the table by the points of these files.

        The points are cached for re-filtering: in memory and on the executors'
        own disks, where a lost executor's part is parsed anew. More points than
        the cluster should cache belong in ``stage_to``, as Parquet."""
        paths = paths if isinstance(paths, str) else list(paths)
        points = self.use(sources.read_points(self.spark, paths), stage_to=stage_to)
        self._paths = paths
        return points

    def use(self, points: DataFrame, *, stage_to: str | None = None) -> DataFrame:
        """Replace the table by ``points``."""
        self._drop_points()
        if stage_to is not None:
            points = sources.stage(points, stage_to)
        else:
            points = self._kept = sources.keep(points)
        self._points = sources.replace_load(points, self.view)
        return self._points

    def _drop_points(self) -> None:
        self.spark.catalog.dropTempView(self.view)
        if self._kept is not None:
            self._kept.unpersist()
        self._points = self._kept = self._paths = self._extents = None

    def load_strikes(self, paths: sources.lylout.Paths, schema: str, **options) -> DataFrame:
        """Replace the table of strikes by the records of delimited text; see
        `read_delimited`. The points stay as they are."""
        paths = paths if isinstance(paths, str) else list(paths)
        return sources.replace_load(sources.read_delimited(self.spark, paths, schema, **options), self.strikes)

    def clear(self) -> None:
        """Drop both tables and release the cache."""
        self._drop_points()
        sources.clear(self.spark, view=self.view, strikes=self.strikes)

    def set_thresholds(self, **changes: float) -> DataFrame:
        """Change some thresholds and return the new selection."""
        self.thresholds = replace(self.thresholds, **changes)
        self._extents = None
        return self.selection()

    def points(self) -> DataFrame:
        if self._points is None:
            raise LookupError("no points are loaded")
        return self._points

    def selection(self) -> DataFrame:
        return operators.filter_points(self.points(), self.thresholds)

    def load_report(self) -> DataFrame:
        """Rows per file; after `load` with the skipped and empty files, too."""
        if self._paths is None:
            return sources.load_report(self.points())
        return sources.load_report(self.points(), sources.list_files(self.spark, self._paths))

    def extent(self) -> DataFrame:
        """One row with the number of selected points and their bounds, worked
        out once for each selection and then a constant of every view."""
        if self._extents is None:
            found = operators.point_extent(self.selection())
            self._extents = self.spark.createDataFrame(found.collect(), found.schema)
        return self._extents

    def panel_extent(self) -> DataFrame:
        return operators.panel_extent(self.extent())

    def ticks(self) -> DataFrame:
        extents = self.extent()
        return operators.axis_ticks_5(extents).unionByName(operators.axis_ticks_3(extents))

    def panel(self, name: str) -> DataFrame:
        return operators.panel(self.selection(), name, extents=self.extent())

    def panels(self) -> DataFrame:
        return operators.panels(self.selection(), extents=self.extent())

    def raster(self, name: str, width: int, height: int, palette=None) -> DataFrame:
        """Cells of one panel, coloured when a palette (RGB triples) is given."""
        if name not in PANELS:
            raise ValueError(f"unknown panel {name!r}; known: {', '.join(PANELS)}")
        cells = operators.raster(self.selection(), name, width, height, extents=self.extent())
        if palette is None:
            return cells
        return operators.apply_palette(cells, palette)

    def rasters(self, width: int, height: int) -> DataFrame:
        return operators.rasters(self.selection(), width, height, extents=self.extent())

    def frames(self, name: str, width: int, height: int, frames: int) -> DataFrame:
        return operators.raster_frames(self.selection(), name, width, height, frames, extents=self.extent())

    def alt_histogram(self, bins: int = 20) -> DataFrame:
        return operators.alt_histogram(self.selection(), bins, extents=self.extent())

    def export_parquet(self, path: str, **options) -> None:
        sources.write_parquet(self.selection(), path, **options)

    def export_dat(self, path: str, **options) -> list[str]:
        return sources.write_dat(self.selection(), path, **options)
