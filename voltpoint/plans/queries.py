"""One named query per operator, all over the given tables.

Ingest queries read text files that Spark writes from the whole ``events``
table; the others read the table itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint import functions as P
from voltpoint import operators as O
from voltpoint import sources as S
from voltpoint.plans import adapter
from voltpoint.schema import POINT_COLUMNS, Thresholds

Query = Callable[[SparkSession, str], DataFrame]

RASTER = {"width": 64, "height": 32}
FRAMES = 6
HISTOGRAM_BINS = 20
STRICT = Thresholds(min_stations=8, min_alt=2, max_alt=12, max_chi=1.1, min_power=-20, max_power=35.5)
# Made-up colours of a five-entry palette.
PALETTE = [(0.0, 0.0, 0.25), (0.0, 0.5, 0.75), (0.25, 0.75, 0.25), (1.0, 0.75, 0.0), (0.75, 0.0, 0.0)]
LINEITEM_BOUNDS = {
    "l_quantity": (5.0, 45.0),
    "l_extendedprice": (1000.0, 80000.0),
    "l_discount": (0.01, 0.09),
}


def _day(column: str = "file_day") -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias("file_day")


def _selection(spark: SparkSession, sf: str) -> DataFrame:
    return O.filter_points(adapter.event_points(spark, sf))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.event_points(spark, sf)


# --- files -----------------------------------------------------------------


def scan_lylout(spark, sf):
    return S.read_lines(spark, adapter.event_files(spark, sf)).select(_day(), "line")


STREAMED = {"whole_file_bytes": -1, "whole_gzip_bytes": -1}


def scan_lylout_streamed(spark, sf):
    """`scan_lylout` with every file read as a stream of lines."""
    return S.read_lines(spark, adapter.event_files(spark, sf), **STREAMED).select(_day(), "line")


def scan_nested(spark, sf):
    """The folder above all files, given with one of the folders inside it."""
    root = adapter.event_root(spark, sf)
    paths = [f"{root}/2024/plain", root]
    return S.read_lines(spark, paths).select(_day(), "line")


def _line_counts(lines: DataFrame) -> DataFrame:
    is_header = F.col("line").contains("header line")
    return lines.groupBy(_day()).agg(
        F.count("*").alias("lines"), F.count_if(is_header).alias("header_lines")
    )


def skip_header(spark, sf):
    return _line_counts(S.read_lines(spark, adapter.event_files(spark, sf)))


def skip_header_streamed(spark, sf):
    """`skip_header` with every file read as a stream of lines."""
    folders = adapter.event_files(spark, sf)
    return _line_counts(S.read_lines(spark, folders, **STREAMED))


def file_filter(spark, sf):
    names = adapter.event_file_names(spark, sf)
    return names.where(P.file_name_matches(F.col("path"))).select("event_id", "path")


def file_date(spark, sf):
    names = adapter.event_file_names(spark, sf)
    day = P.file_day(F.col("path"))
    return names.select(
        "event_id", (F.unix_date(day).cast("bigint") * F.lit(86400)).alias("day_s")
    )


def rows_per_day(spark, sf):
    points = S.read_points(spark, adapter.event_files(spark, sf))
    return points.groupBy(_day()).agg(F.count("*").alias("rows"))


def union_days(spark, sf):
    loads = [S.read_points(spark, folder) for folder in adapter.event_files(spark, sf)]
    both = loads[0].unionByName(loads[1])
    return both.select(_day(), *POINT_COLUMNS)


def load_report(spark, sf):
    """Per day of all files, the empty and those of other names included."""
    folders = adapter.event_files(spark, sf)
    report = S.load_report(S.read_points(spark, folders), S.list_files(spark, folders))
    return report.groupBy("matched", _day()).agg(
        F.sum("rows").alias("rows"),
        F.sum("null_epoch_ns").alias("null_times"),
        F.sum("null_alt").alias("null_alts"),
        F.sum("null_number_stations").alias("null_stations"),
    )


def parse_lylout(spark, sf):
    points = S.read_points(spark, adapter.event_files(spark, sf))
    return points.select(_day(), *POINT_COLUMNS)


def parse_lylout_streamed(spark, sf):
    points = S.read_points(spark, adapter.event_files(spark, sf), **STREAMED)
    return points.select(_day(), *POINT_COLUMNS)


def clear_table(spark, sf):
    """Rows of the table before it is cleared, and whether it is there after."""
    view = "voltpoint_clear_table"
    rows = O.extent(S.replace_load(_points(spark, sf), view), [], count="rows")
    S.clear(spark, view=view)
    return rows.withColumn("exists_after", F.lit(spark.catalog.tableExists(view)))


def scan_ctg(spark, sf):
    """Strikes of delimited text, with the records that cannot be read whole."""
    path = adapter.strike_files(spark, sf)
    return S.read_delimited(spark, path, adapter.STRIKE_SCHEMA, delimiter=";", comment="#")


def clear_ctg(spark, sf):
    """Both tables before they are cleared, and whether they are there after."""
    view, strikes = "voltpoint_clear_points", "voltpoint_clear_strikes"
    points = O.extent(S.replace_load(_points(spark, sf), view), [], count="points")
    rows = O.extent(S.replace_load(scan_ctg(spark, sf).select("event_id", "us"), strikes), [], count="strikes")
    S.clear(spark, view=view, strikes=strikes)
    after = [F.lit(spark.catalog.tableExists(name)).alias(f"{kind}_after") for kind, name in (("points", view), ("strikes", strikes))]
    return points.select("points", rows.scalar().alias("strikes"), *after)


def versioned_load(spark, sf):
    """Two loads one after the other, the files of the first given again."""
    plain, zipped = adapter.event_files(spark, sf)
    store = S.PointStore(spark, S.scratch_folder(spark))
    store.replace(plain)
    for paths in ([plain, zipped], zipped, plain):
        store.append(paths)
    return store.points().select(_day(), *POINT_COLUMNS)


def stored_report(spark, sf):
    """`load_report` from the ledger that a load keeps."""
    return adapter.event_store(spark, sf).report().groupBy("matched", _day()).agg(
        F.sum("rows").alias("rows"),
        F.sum("null_epoch_ns").alias("null_times"),
        F.sum("null_alt").alias("null_alts"),
        F.sum("null_number_stations").alias("null_stations"),
    )


def stored_extent(spark, sf):
    """The extent of all points from the extents of their days."""
    return adapter.event_store(spark, sf).extent()


STORED_DAYS = ("2024-01-05", "2024-01-11")


def stored_extent_days(spark, sf):
    return adapter.event_store(spark, sf).extent(STORED_DAYS)


def replace_load(spark, sf):
    view = "voltpoint_replace_load"
    points = _points(spark, sf)
    S.replace_load(points.withColumn("alt", F.col("alt") + F.lit(100).cast("float")), view)
    table = S.replace_load(points, view)
    return O.extent(table, ["alt"], count="rows")


# --- line parsing ----------------------------------------------------------


def _tokens(spark, sf):
    lines = adapter.event_lines(spark, sf)
    return lines.select("event_id", "file_day", P.split_spaces(F.col("line")).alias("tokens"))


def tokenize(spark, sf):
    return _tokens(spark, sf).select(
        "event_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", "|").alias("joined"),
    )


def array_get(spark, sf):
    tokens = F.col("tokens")
    return _tokens(spark, sf).select(
        "event_id", *[P.token(tokens, i).alias(f"token_{i}") for i in (1, 2, 4, 7, 8)]
    )


def try_cast_double(spark, sf):
    return _tokens(spark, sf).select(
        "event_id",
        *[P.to_double(P.token(F.col("tokens"), i)).alias(f"double_{i}") for i in (2, 3, 4)],
    )


def try_cast_float(spark, sf):
    return _tokens(spark, sf).select(
        "event_id",
        *[P.to_float(P.token(F.col("tokens"), i)).alias(f"float_{i}") for i in (4, 5, 6)],
    )


def try_expr(spark, sf):
    metres = P.to_double(P.token(F.col("tokens"), 4))
    return _tokens(spark, sf).select("event_id", (metres / F.lit(1000.0)).alias("km"))


def alt_km(spark, sf):
    return _tokens(spark, sf).select(
        "event_id", P.alt_km(P.token(F.col("tokens"), 4)).alias("alt")
    )


def make_epoch_ns(spark, sf):
    return _tokens(spark, sf).select(
        "event_id", P.epoch_ns(P.token(F.col("tokens"), 1), F.col("file_day")).alias("epoch_ns")
    )


def station_count(spark, sf):
    return _tokens(spark, sf).select(
        "event_id", P.station_count(P.token(F.col("tokens"), 7)).alias("number_stations")
    )


def epoch_ns_of_ts(spark, sf):
    events = adapter.table(spark, sf, "events")
    return events.select("event_id", P.epoch_ns_of_timestamp(F.col("ts")).alias("epoch_ns"))


# --- selection -------------------------------------------------------------


def _one_bound(column: str) -> Query:
    def query(spark, sf):
        bounds = {column: Thresholds().bounds()[column]}
        return O.range_filter(_points(spark, sf), bounds).select("event_id", column)

    return query


def filter_points(spark, sf):
    return _selection(spark, sf)


def refilter(spark, sf):
    points = _points(spark, sf)

    def count(label: str, thresholds: Thresholds) -> Column:
        inside = O.range_condition(points.schema, thresholds.bounds())
        return F.count_if(inside).alias(label)

    wide = Thresholds(min_stations=0, max_alt=1e4, max_chi=1e4, min_power=-1e4, max_power=1e4)
    sets = {"default": Thresholds(), "strict": STRICT, "wide": wide}
    counts = points.agg(*[count(label, thresholds) for label, thresholds in sets.items()])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("thresholds"), F.col(s).alias("n")) for s in sets]))
    )


def refilter_kept(spark, sf):
    """One kept table, filtered anew for each set of thresholds and released."""
    kept = S.keep(_points(spark, sf))
    wide = Thresholds(min_stations=0, max_alt=1e4, max_chi=1e4, min_power=-1e4, max_power=1e4)
    counts = None
    for label, thresholds in {"default": Thresholds(), "strict": STRICT, "wide": wide}.items():
        found = O.filter_points(kept, thresholds).agg(F.count("*").alias("n"))
        found = found.select(F.lit(label).alias("thresholds"), "n")
        counts = found if counts is None else counts.unionByName(found)
    path = S.scratch_folder(spark)
    counts.write.parquet(path)
    S.clear(spark, kept)
    return spark.read.parquet(path)


CUBE_EDGES = {
    "number_stations": [4.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0],
    "alt": [0.0, 2.0, 5.0, 10.0, 12.0, 15.0, 20.0],
    "chi": [0.0, 1.0, 2.0, 5.0],
    "pdb": [-60.0, -20.0, 0.0, 20.0, 60.0],
}
#: Twenty sets: half at the edges of the cube, half between them.
CUBE_SETS = {f"edges_{k}": Thresholds(min_stations=4 + k % 6, min_alt=2 * (k % 2), max_alt=20 - 5 * (k % 3), max_chi=5 - k % 4, min_power=-60 + 40 * (k % 2)) for k in range(10)}
CUBE_SETS |= {f"between_{k}": Thresholds(min_stations=5 + k % 7, min_alt=0.3 * k, max_alt=19.1 - k, max_chi=5 - 0.37 * k, min_power=-60 + 3.5 * k, max_power=60 - 4.5 * k) for k in range(10)}


def refilter_cube(spark, sf):
    """Twenty threshold sets from one cube and one look at the points they cut."""
    points = _points(spark, sf)
    cube = S.written(O.threshold_cube(points, CUBE_EDGES))
    return O.cube_counts(points, cube, CUBE_EDGES, CUBE_SETS)


def refilter_clustered(spark, sf):
    """The strict selection of a table in the order of a space-filling curve."""
    staged = S.cluster(_points(spark, sf), S.scratch_folder(spark))
    return O.filter_points(staged, STRICT)


def refilter_strict(spark, sf):
    return O.filter_points(_points(spark, sf), STRICT)


def project_points(spark, sf):
    return O.project_points(_selection(spark, sf))


def range_filter_lineitem(spark, sf):
    items = adapter.table(spark, sf, "lineitem")
    return O.range_filter(items, LINEITEM_BOUNDS).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )


# --- extents and views -----------------------------------------------------


def extent(spark, sf):
    return O.point_extent(_selection(spark, sf))


def extent_per_row(spark, sf):
    return O.extent_per_row(_selection(spark, sf))


def panel_extent(spark, sf):
    return O.panel_extent(O.point_extent(_selection(spark, sf)))


def source_count(spark, sf):
    return O.point_extent(_selection(spark, sf)).select("source_count")


def extent_lineitem(spark, sf):
    items = adapter.table(spark, sf, "lineitem")
    return O.extent(items, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def axis_ticks_5(spark, sf):
    return O.axis_ticks_5(O.point_extent(_selection(spark, sf)))


def axis_ticks_3(spark, sf):
    return O.axis_ticks_3(O.point_extent(_selection(spark, sf)))


def relative_time(spark, sf):
    return O.relative_time(_selection(spark, sf)).select("event_id", "rel_ns", "t")


def normalize_time(spark, sf):
    return O.normalize_time(_selection(spark, sf)).select("event_id", "color")


def _panel(name: str) -> Query:
    return lambda spark, sf: O.panel(_selection(spark, sf), name)


def panels(spark, sf):
    return O.panels(_selection(spark, sf))


def _raster(name: str) -> Query:
    return lambda spark, sf: O.raster(_selection(spark, sf), name, **RASTER)


def rasters(spark, sf):
    return O.rasters(_selection(spark, sf), **RASTER)


def raster_frames(spark, sf):
    return O.raster_frames(_selection(spark, sf), "lon_lat", frames=FRAMES, **RASTER)


def alt_histogram(spark, sf):
    return O.alt_histogram(_selection(spark, sf), HISTOGRAM_BINS)


def grid_lineitem(spark, sf):
    items = adapter.table(spark, sf, "lineitem")
    return O.grid(items, "l_quantity", "l_extendedprice", 40, 30, latest="l_orderkey")


def point_colors(spark, sf):
    colored = O.normalize_time(_selection(spark, sf))
    return O.apply_palette(colored, PALETTE).select("event_id", "red", "green", "blue")


# Five minutes and 25 km, over plain scales of a degree.
FLASH = {"max_gap_ns": 300_000_000_000, "max_km": 25.0, "km_per_lon": 93.0, "km_per_lat": 111.0}


def flash_group(spark, sf):
    return O.flash_groups(_points(spark, sf), "event_id", **FLASH).select("event_id", "flash_id")


def flash_summary(spark, sf):
    groups = O.flash_groups(_selection(spark, sf), "event_id", **FLASH)
    return O.flash_summary(groups).select("flash_id", "sources", "t_min_ns", "t_max_ns")


# --- dirty values and windows -------------------------------------------------


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    return O.filter_points(adapter.dirty_points(spark, sf))


def dirty_extent(spark, sf):
    return O.point_extent(_dirty(spark, sf))


def dirty_relative_time(spark, sf):
    return O.relative_time(_dirty(spark, sf)).select("event_id", "rel_ns", "t")


def dirty_ticks(spark, sf):
    ticks = O.axis_ticks_5(O.point_extent(_dirty(spark, sf)))
    # Labels of values without a sixth decimal have no counterpart in SQL.
    return ticks.withColumn("label", F.when(F.abs("value") < 1e15, F.col("label")))


def dirty_panels(spark, sf):
    return O.panels(_dirty(spark, sf))


def dirty_rasters(spark, sf):
    return O.rasters(_dirty(spark, sf), **RASTER)


def dirty_parquet(spark, sf):
    path = S.scratch_folder(spark)
    return S.stage(_dirty(spark, sf).drop("event_id"), path).select(*POINT_COLUMNS)


# A part of the map, narrower than the data.
WINDOW = {"lon_min": -101.75, "lon_max": -101.25, "lat_min": 33.25, "lat_max": 33.5}


def raster_window(spark, sf):
    points = _selection(spark, sf)
    fixed = [F.lit(v).cast("float").alias(name) for name, v in WINDOW.items()]
    return O.raster(points, "lon_lat", **RASTER, extents=O.point_extent(points).select("t_min_ns", "t_max_ns", *fixed))


# --- export ----------------------------------------------------------------


def parquet_round_trip(spark, sf):
    path = S.scratch_folder(spark)
    points = _selection(spark, sf).drop("event_id")
    return S.stage(points, path).select(_day(), *POINT_COLUMNS)


def dat_round_trip(spark, sf):
    path = S.scratch_folder(spark)
    S.write_dat(_selection(spark, sf), path)
    points = S.read_points(spark, path)
    # The text format resolves about a quarter of a microsecond.
    micros = P.floor_div(F.col("epoch_ns") + F.lit(500), 1000)
    return points.select(micros.alias("epoch_us"), *[c for c in POINT_COLUMNS if c != "epoch_ns"])


_QUERIES: dict[str, Query] = {
    "scan_lylout": scan_lylout,
    "scan_lylout_streamed": scan_lylout_streamed,
    "scan_nested": scan_nested,
    "skip_header": skip_header,
    "skip_header_streamed": skip_header_streamed,
    "file_filter": file_filter,
    "file_date": file_date,
    "rows_per_day": rows_per_day,
    "union_days": union_days,
    "load_report": load_report,
    "replace_load": replace_load,
    "parse_lylout": parse_lylout,
    "parse_lylout_streamed": parse_lylout_streamed,
    "clear_table": clear_table,
    "scan_ctg": scan_ctg,
    "clear_ctg": clear_ctg,
    "versioned_load": versioned_load,
    "stored_report": stored_report,
    "stored_extent": stored_extent,
    "stored_extent_days": stored_extent_days,
    "tokenize": tokenize,
    "array_get": array_get,
    "try_cast_double": try_cast_double,
    "try_cast_float": try_cast_float,
    "try_expr": try_expr,
    "alt_km": alt_km,
    "make_epoch_ns": make_epoch_ns,
    "station_count": station_count,
    "epoch_ns_of_ts": epoch_ns_of_ts,
    "relative_time": relative_time,
    "normalize_time": normalize_time,
    "filter_stations": _one_bound("number_stations"),
    "filter_alt": _one_bound("alt"),
    "filter_chi": _one_bound("chi"),
    "filter_power": _one_bound("pdb"),
    "filter_points": filter_points,
    "refilter": refilter,
    "refilter_kept": refilter_kept,
    "refilter_strict": refilter_strict,
    "refilter_cube": refilter_cube,
    "refilter_clustered": refilter_clustered,
    "project_points": project_points,
    "range_filter_lineitem": range_filter_lineitem,
    "extent": extent,
    "extent_per_row": extent_per_row,
    "panel_extent": panel_extent,
    "source_count": source_count,
    "extent_lineitem": extent_lineitem,
    "axis_ticks_5": axis_ticks_5,
    "axis_ticks_3": axis_ticks_3,
    "panel_time_alt": _panel("time_alt"),
    "panel_lon_alt": _panel("lon_alt"),
    "panel_lon_lat": _panel("lon_lat"),
    "panel_alt_lat": _panel("alt_lat"),
    "panels": panels,
    "raster_time_alt": _raster("time_alt"),
    "raster_lon_alt": _raster("lon_alt"),
    "raster_lon_lat": _raster("lon_lat"),
    "raster_alt_lat": _raster("alt_lat"),
    "rasters": rasters,
    "raster_frames": raster_frames,
    "alt_histogram": alt_histogram,
    "grid_lineitem": grid_lineitem,
    "point_colors": point_colors,
    "raster_window": raster_window,
    "flash_group": flash_group,
    "flash_summary": flash_summary,
    "dirty_extent": dirty_extent,
    "dirty_relative_time": dirty_relative_time,
    "dirty_ticks": dirty_ticks,
    "dirty_panels": dirty_panels,
    "dirty_rasters": dirty_rasters,
    "dirty_parquet": dirty_parquet,
    "parquet_round_trip": parquet_round_trip,
    "dat_round_trip": dat_round_trip,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection with relative time and colour value: what every view shows."""
    points = _selection(spark, sf_dir)
    extents = O.point_extent(points)
    return O.normalize_time(O.relative_time(points, extents), extents)
