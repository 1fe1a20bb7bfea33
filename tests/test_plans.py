"""What the physical plans must and must not contain."""

import points as pts
import pytest

from voltpoint import operators as O
from voltpoint.plans import adapter

VIEWS = {
    "filter": lambda p: O.filter_points(p),
    "extent": lambda p: O.point_extent(p),
    "extent_per_row": lambda p: O.extent_per_row(p),
    "relative_time": lambda p: O.relative_time(p),
    "panels": lambda p: O.panels(p),
    "rasters": lambda p: O.rasters(p, 64, 32),
    "frames": lambda p: O.raster_frames(p, "lon_lat", 64, 32, 10),
    "histogram": lambda p: O.alt_histogram(p),
    "ticks": lambda p: O.axis_ticks_5(O.point_extent(p)),
}
NO_SHUFFLE_OF_ROWS = ("filter", "extent_per_row", "relative_time", "panels")


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.count()
    return pts.plan_of(df)


@pytest.fixture
def selection(spark, sf_dir):
    return O.filter_points(adapter.event_points(spark, sf_dir))


@pytest.mark.parametrize("name", list(VIEWS))
def test_no_python_no_join_no_window(selection, name):
    plan = pts.plan_of(VIEWS[name](selection))
    for node in ("Python", "Pandas", "InArrow", "Join", "CartesianProduct", "Window"):
        assert node not in plan


@pytest.mark.parametrize("name", list(VIEWS))
def test_every_shuffle_is_behind_a_partial_aggregate(selection, name):
    lines = pts.plan_of(VIEWS[name](selection)).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    for i in shuffles:
        assert "HashAggregate" in lines[i + 1] and "partial_" in lines[i + 1]


@pytest.mark.parametrize("name", NO_SHUFFLE_OF_ROWS)
def test_rows_are_not_shuffled(selection, name):
    # The only shuffle, if any, is the one-row aggregate inside the subquery.
    lines = pts.plan_of(VIEWS[name](selection)).splitlines()
    outer = [line for line in lines if "Exchange" in line and "SinglePartition" not in line]
    assert outer == []


def test_the_extent_is_computed_once(spark, selection):
    group = "voltpoint-extent-once"
    spark.sparkContext.setJobGroup(group, group)
    try:
        O.extent_per_row(selection).write.format("noop").mode("overwrite").save()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # partial + final aggregate of the extent, and the rows
    assert len(jobs) <= 3


def test_only_the_needed_columns_are_read(spark, sf_dir, tmp_path):
    from voltpoint import sources as S

    staged = S.stage(adapter.event_points(spark, sf_dir), str(tmp_path / "s"))
    plan = pts.plan_of(O.normalize_time(staged).select("color"))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("epoch_ns" in s and not any(c in s for c in ("lon", "lat", "alt")) for s in schemas)
