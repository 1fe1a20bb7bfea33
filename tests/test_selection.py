"""Closed ranges, thresholds and NULLs."""

import numpy as np
import points as pts
import pytest
from pyspark.sql import functions as F

from voltpoint import operators as O
from voltpoint import sources as S
from voltpoint.schema import Thresholds


def alts(df):
    return sorted(r.alt for r in df.collect())


def test_defaults():
    assert Thresholds().bounds() == {
        "number_stations": (6.0, None),
        "alt": (0.0, 20.0),
        "chi": (0.0, 5.0),
        "pdb": (-60.0, 60.0),
    }


def test_thresholds_are_single_precision_with_six_decimals():
    assert Thresholds(min_alt=0.12345678).min_alt == 0.123457
    assert Thresholds(max_alt=16777217.0).max_alt == float(np.float32(16777217.0))


def test_bounds_are_inclusive(spark):
    rows = [
        {},
        {"number_stations": 6, "alt": 0.0, "chi": 0.0, "pdb": -60.0},
        {"number_stations": 6, "alt": 20.0, "chi": 5.0, "pdb": 60.0},
        {"number_stations": 5},
        {"alt": -0.001},
        {"alt": 20.001},
        {"chi": 5.001},
        {"chi": -0.001},
        {"pdb": 60.01},
        {"pdb": -60.01},
    ]
    assert alts(O.filter_points(pts.frame(spark, rows))) == [0.0, 8.0, 20.0]


def test_a_float_equals_its_threshold(spark):
    points = pts.frame(spark, [{"alt": 0.1}, {"alt": 0.7}])
    assert O.filter_points(points, Thresholds(min_alt=0.1, max_alt=0.7)).count() == 2


def test_null_and_nan_fail_but_unfiltered_columns_may_be_null(spark):
    rows = [
        {"alt": None},
        {"chi": None},
        {"pdb": None},
        {"number_stations": None},
        {"alt": float("nan")},
        {"epoch_ns": None, "alt": 1.0},
        {"lat": None, "lon": None, "alt": 2.0},
    ]
    assert alts(O.filter_points(pts.frame(spark, rows))) == [1.0, 2.0]


def test_fractional_station_threshold(spark):
    points = pts.frame(spark, [{"number_stations": n, "alt": float(n)} for n in (6, 7, 8)])
    assert alts(O.filter_points(points, Thresholds(min_stations=6.5))) == [7.0, 8.0]


def test_idempotent_and_monotone(spark, sf_dir):
    from voltpoint.plans import adapter

    points = adapter.event_points(spark, sf_dir)
    once = O.filter_points(points)
    assert O.filter_points(once).count() == once.count()
    tight = O.filter_points(points, Thresholds(min_stations=8, max_alt=10))
    assert tight.exceptAll(once).count() == 0 and 0 < tight.count() < once.count()


def test_no_bounds_keep_all(spark):
    assert O.range_filter(pts.frame(spark, [{}, {"alt": None}]), {}).count() == 2


def test_ranges_reach_the_parquet_scan(spark, conf, tmp_path):
    conf("spark.sql.maxMetadataStringLength", "5000")
    staged = S.stage(pts.frame(spark, [{}]), str(tmp_path / "p"))
    plan = pts.plan_of(O.project_points(O.filter_points(staged)))
    pushed = plan[plan.index("PushedFilters") :]
    for term in (
        "GreaterThanOrEqual(number_stations,6)",
        "GreaterThanOrEqual(alt,0.0)",
        "LessThanOrEqual(alt,20.0)",
        "LessThanOrEqual(chi,5.0)",
        "GreaterThanOrEqual(pdb,-60.0)",
    ):
        assert term in pushed


def test_only_needed_columns_are_read(spark, tmp_path):
    staged = S.stage(pts.frame(spark, [{}]), str(tmp_path / "p"))
    plan = pts.plan_of(O.range_filter(staged, {"alt": (1, 2)}).select("lon"))
    assert "ReadSchema: struct<lon:float,alt:float>" in plan


@pytest.mark.parametrize("day", ["2023-11-14", "2023-11-15"])
def test_days_prune_folders(spark, tmp_path, day):
    rows = [{}, {"epoch_ns": pts.DEFAULTS["epoch_ns"] + 86_400_000_000_000}]
    staged = S.stage(pts.frame(spark, rows), str(tmp_path / "p"))
    one = staged.where(F.col("file_day") == F.lit(day).cast("date"))
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(file_day" in pts.plan_of(one)
