"""Extents, ticks, panels, rasters and colours."""

import math

import numpy as np
import points as pts
import pytest
from pyspark.sql import functions as F

from voltpoint import operators as O
from voltpoint.plans import adapter
from voltpoint.schema import EXTENT_PANELS, PANELS

T0 = pts.DEFAULTS["epoch_ns"]


@pytest.fixture(scope="module")
def selection(spark, sf_dir):
    return O.filter_points(adapter.event_points(spark, sf_dir)).cache()


def test_empty_selection(spark):
    empty = pts.frame(spark, [{}]).where("false")
    row = O.point_extent(empty).first().asDict()
    assert row.pop("source_count") == 0
    assert set(row.values()) == {None}
    assert O.panels(empty).count() == 0
    assert O.extent_per_row(empty).count() == 0
    assert O.rasters(empty, 8, 8).count() == 0
    ticks = O.axis_ticks_5(O.point_extent(empty)).collect()
    assert len(ticks) == 25 and {t.value for t in ticks} == {None}


def test_single_point(spark):
    one = pts.frame(spark, [{}])
    assert O.point_extent(one).first().span_ns == 0
    assert [r.color for r in O.normalize_time(one).collect()] == [None]
    cells = O.rasters(one, 8, 4).collect()
    assert {(c.px, c.py, c.n) for c in cells} == {(0, 0, 1)} and len(cells) == 4
    assert O.alt_histogram(one).collect() == [(0, 1)]


def test_extent_ignores_null_nan_and_infinity(spark):
    rows = [
        {"lat": None, "lon": 1.0},
        {"lat": float("nan"), "lon": float("inf")},
        {"lat": 40.0, "lon": 3.0, "epoch_ns": None},
        {"lat": 41.0, "lon": -float("inf"), "epoch_ns": T0 + 5},
    ]
    row = O.point_extent(pts.frame(spark, rows)).first()
    assert (row.source_count, row.lat_min, row.lat_max, row.lon_min, row.lon_max) == (4, 40.0, 41.0, 1.0, 3.0)
    assert (row.t_min_ns, row.span_ns) == (T0, 5)


def test_points_without_coordinates_stay_out_of_their_panels(spark):
    rows = [{"lat": None}, {"lon": float("nan"), "alt": 9.0}, {"epoch_ns": None}, {"epoch_ns": T0 + 1}]
    counts = {
        r.panel: r["count"] for r in O.panels(pts.frame(spark, rows)).groupBy("panel").count().collect()
    }
    assert counts == {"time_alt": 3, "lon_alt": 3, "lon_lat": 2, "alt_lat": 3}


def test_time_is_exact(spark):
    rows = [{"epoch_ns": T0 + d} for d in (0, 1, 999_999_999, 600_000_000_001)]
    got = sorted(r.rel_ns for r in O.relative_time(pts.frame(spark, rows)).collect())
    assert got == [0, 1, 999_999_999, 600_000_000_001]


def test_latest_point_colors_the_cell_in_any_order(spark):
    rows = [{"epoch_ns": T0 + 10 * d} for d in (3, 0, 4, 1)] + [{"lat": 34.0, "epoch_ns": T0 + 100}]
    cells = O.raster(pts.frame(spark, rows), "lon_lat", 8, 8).orderBy("py").collect()
    assert [(c.py, c.n, c.last_ns, c.color) for c in cells] == [(0, 4, T0 + 40, 0.4), (7, 1, T0 + 100, 1.0)]


def test_panels_have_equal_row_counts(selection):
    counts = {r.panel: r["count"] for r in O.panels(selection).groupBy("panel").count().collect()}
    assert counts == dict.fromkeys(PANELS, selection.count())
    for name in PANELS:
        single = O.panel(selection, name)
        both = O.panels(selection).where(F.col("panel") == name).drop("panel")
        assert single.exceptAll(both).count() == 0


@pytest.mark.parametrize("name", list(PANELS))
def test_raster_against_brute_force(selection, name):
    width, height = 13, 7
    rows = selection.collect()
    t0 = min(r.epoch_ns for r in rows)
    value = {"time": lambda r: float(r.epoch_ns - t0), "lon": lambda r: r.lon, "lat": lambda r: r.lat, "alt": lambda r: r.alt}
    x, y = (value[a] for a in PANELS[name])
    lo = [min(map(f, rows)) for f in (x, y)]
    hi = [max(map(f, rows)) for f in (x, y)]
    want: dict = {}
    for r in rows:
        cell = tuple(
            min(n - 1, math.floor((f(r) - a) / (b - a) * n))
            for f, a, b, n in zip((x, y), lo, hi, (width, height))
        )
        last, n = want.get(cell, (0, 0))
        want[cell] = (max(last, r.epoch_ns), n + 1)
    got = {(c.px, c.py): (c.last_ns, c.n) for c in O.raster(selection, name, width, height).collect()}
    assert got == want
    shared = O.rasters(selection, width, height).where(F.col("panel") == name)
    assert {(c.px, c.py): (c.last_ns, c.n) for c in shared.collect()} == want


def test_counts_add_up(selection):
    n = selection.count()
    total = {r.panel: r.n for r in O.rasters(selection, 30, 20).groupBy("panel").agg(F.sum("n").alias("n")).collect()}
    assert total == dict.fromkeys(PANELS, n)
    assert O.raster_frames(selection, "lon_lat", 30, 20, 7).agg(F.sum("n")).first()[0] == n
    assert O.alt_histogram(selection, 9).agg(F.sum("n")).first()[0] == n


def test_frames_partition_the_raster(selection):
    frames = O.raster_frames(selection, "lon_alt", 16, 8, 5)
    assert {r.frame for r in frames.select("frame").distinct().collect()} == {0, 1, 2, 3, 4}
    merged = frames.groupBy("px", "py").agg(F.max("last_ns").alias("last_ns"), F.sum("n").alias("n"))
    whole = O.raster(selection, "lon_alt", 16, 8).select("px", "py", "last_ns", "n")
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_panel_extents(selection):
    ext = O.point_extent(selection).first()
    rows = {r.panel: r for r in O.panel_extent(O.point_extent(selection)).collect()}
    assert set(rows) == set(EXTENT_PANELS)
    assert (rows["alt_hist"].x_min, rows["alt_hist"].y_max) == (None, ext.alt_max)
    assert (rows["time_alt"].x_min, rows["time_alt"].x_max) == (0.0, float(np.float32(ext.span_ns)))
    assert (rows["alt_lat"].x_min, rows["alt_lat"].y_min) == (ext.alt_min, ext.lat_min)


def test_ticks_in_single_precision(selection):
    extents = O.point_extent(selection)
    bounds = {r.panel: r for r in O.panel_extent(extents).collect()}
    f = np.float32
    ticks = O.axis_ticks_5(extents).collect() + O.axis_ticks_3(extents).collect()
    assert len(ticks) == 25 + 12
    for t in ticks:
        low, high = (f(getattr(bounds[t.panel], f"{t.axis}_{s}")) for s in ("min", "max"))
        is_alt = dict(zip("xy", EXTENT_PANELS[t.panel]))[t.axis] == "alt"
        fraction = f(0.1) + f(t.i) * (f(0.4) if is_alt else f(0.2))
        value = low + fraction * (high - low)
        assert f(t.fraction) == fraction and f(t.value) == value
        assert t.label == f"{float(value):.6f}"
        assert low <= value <= high
    with pytest.raises(ValueError):
        O.axis_ticks(extents, 4)


def test_palette_interpolates_between_entry_centres(spark):
    palette = [(0.0, 1.0, 0.5), (1.0, 0.0, 0.5), (0.0, 0.0, 0.0), (0.25, 0.5, 1.0)]
    values = [0.0, 0.05, 0.125, 0.25, 0.3, 0.5, 0.874, 0.875, 0.99, 1.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "color double")
    for r in O.apply_palette(rows, palette).collect():
        if r.color is None:
            assert (r.red, r.green, r.blue) == (None, None, None)
            continue
        centres = [(i + 0.5) / len(palette) for i in range(len(palette))]
        want = [np.interp(r.color, centres, [p[i] for p in palette]) for i in range(3)]
        assert (r.red, r.green, r.blue) == pytest.approx(want, abs=1e-12)


def test_large_palette_is_compiled_in(spark):
    palette = [(i / 255, 1 - i / 255, 0.5) for i in range(256)]
    colored = O.apply_palette(spark.range(1000).select((F.col("id") / 999).alias("color")), palette)
    assert "Join" not in pts.plan_of(colored)
    top = colored.orderBy(F.desc("color")).first()
    assert (top.red, top.green, top.blue) == (1.0, 0.0, 0.5)


def test_grid_over_other_columns(spark):
    rows = [(0.0, 0, 1), (1.0, 10, 2), (0.5, 5, 3), (None, 5, 4), (float("nan"), 5, 5), (0.49, 4, 6)]
    df = spark.createDataFrame(rows, "a double, b int, k int")
    cells = {(c.px, c.py): (c.last, c.n) for c in O.grid(df, "a", "b", 2, 2, latest="k").collect()}
    assert cells == {(0, 0): (6, 2), (1, 1): (3, 2)}


def test_points_outside_a_given_extent_stay_out(spark):
    rows = [{"lon": float(x), "lat": 30.0 + x, "alt": float(x), "epoch_ns": T0 + x} for x in range(10)]
    points = pts.frame(spark, rows)
    narrow = O.point_extent(points.where("lon BETWEEN 3 AND 6"))
    cells = O.raster(points, "lon_lat", 4, 4, extents=narrow).collect()
    assert sorted((c.px, c.py, c.n) for c in cells) == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert sorted(tuple(r) for r in O.alt_histogram(points, 3, narrow).collect()) == [(0, 1), (1, 1), (2, 2)]
    assert O.rasters(points, 4, 4, narrow).groupBy("panel", "px", "py").count().where("count > 1").count() == 0
    frames = O.raster_frames(points, "lon_lat", 4, 4, 2, narrow)
    assert {r.frame for r in frames.collect()} == {0, 1}


def test_small_negative_and_large_labels(spark):
    from voltpoint.functions import fixed_decimals

    values = [-1e-7, -0.5, 0.0, 1e30, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed_decimals(F.col("v"))).collect()]
    assert got[:3] == ["-0.000000", "-0.500000", "0.000000"]
    assert float(got[3]) == 1e30 and got[4] == "NaN"
