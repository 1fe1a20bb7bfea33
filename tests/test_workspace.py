"""The interactive flow end to end."""

import pytest

from voltpoint import Thresholds, Workspace
from voltpoint.plans import adapter


@pytest.mark.parametrize("staged", [False, True])
def test_flow(spark, sf_dir, tmp_path, staged):
    ws = Workspace(spark)
    with pytest.raises(LookupError):
        ws.selection()
    ws.load(adapter.event_files(spark, sf_dir), stage_to=str(tmp_path / "s") if staged else None)
    assert spark.table("lma").count() == 1000
    n = ws.selection().count()
    assert 0 < n < 1000
    assert ws.extent().first().source_count == n
    assert ws.set_thresholds(min_stations=9).count() < n
    assert ws.thresholds == Thresholds(min_stations=9)
    ws.set_thresholds(min_stations=6)
    assert ws.ticks().count() == 37
    assert ws.panels().count() == 4 * n
    assert ws.panel("lon_lat").count() == n
    assert ws.panel_extent().count() == 5
    assert ws.rasters(8, 8).groupBy().sum("n").first()[0] == 4 * n
    assert {"red", "green", "blue"} <= set(ws.raster("lon_lat", 8, 8, [(0, 0, 0), (1, 1, 1)]).columns)
    with pytest.raises(ValueError, match="time_alt"):
        ws.raster("nowhere", 8, 8)
    assert ws.frames("lon_alt", 4, 4, 3).groupBy().sum("n").first()[0] == n
    assert ws.alt_histogram(5).groupBy().sum("n").first()[0] == n
    ws.export_parquet(str(tmp_path / "p"))
    ws.export_dat(str(tmp_path / "d"))
    other = Workspace(spark)
    other.load(str(tmp_path / "d"))
    assert spark.table("lma").count() == n
    other.clear()
    assert not spark.catalog.tableExists("lma")
    other.clear()


def test_a_load_replaces_the_last(spark, sf_dir):
    ws = Workspace(spark)
    points = adapter.event_points(spark, sf_dir)
    ws.use(points)
    first = ws._kept
    ws.use(points.where("alt > 5"))
    assert spark.table("lma").where("alt <= 5").count() == 0
    assert not first.is_cached and ws._kept.is_cached
    ws.clear()
    assert ws._kept is None


@pytest.mark.parametrize("staged", [False, True])
def test_report_of_loaded_files(spark, sf_dir, tmp_path, staged):
    ws = Workspace(spark)
    ws.load(adapter.event_files(spark, sf_dir), stage_to=str(tmp_path / "s") if staged else None)
    assert ws.load_report().groupBy().sum("rows").first()[0] == 1000
    ws.clear()


def test_report_lists_skipped_and_empty_files(spark, tmp_path):
    from voltpoint.schema import HEADER_LINES

    header = "h\n" * HEADER_LINES
    (tmp_path / "LYLOUT_230517_000000_0600.dat").write_text(header + "1 2 3 4 5 6 7\n")
    (tmp_path / "LYLOUT_230518_000000_0600.dat").write_text(header)
    (tmp_path / "notes.txt").write_text("no")
    ws = Workspace(spark, view="report")
    ws.load(str(tmp_path))
    found = {r.file_path.rsplit("/", 1)[1]: (r.matched, r.rows) for r in ws.load_report().collect()}
    assert sorted(found.values()) == [(False, 0), (True, 0), (True, 1)]
    ws.clear()


def test_two_workspaces_with_names_of_their_own(spark, sf_dir):
    points = adapter.event_points(spark, sf_dir)
    one, two = Workspace(spark, view="one"), Workspace(spark, view="two")
    one.use(points)
    two.use(points)
    one.clear()
    assert spark.table("two").count() == 1000
    two.clear()


def test_the_extent_of_a_selection_is_worked_out_once(spark, sf_dir):
    ws = Workspace(spark, view="once")
    ws.use(adapter.event_points(spark, sf_dir))
    assert ws.extent() is ws.extent()
    plan = ws.ticks()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "FileScan" not in plan
    before = ws.extent()
    ws.set_thresholds(min_stations=9)
    assert ws.extent() is not before
    ws.clear()
