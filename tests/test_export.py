"""Parquet and text export."""

import datetime
import gzip
from collections import Counter
from pathlib import Path

import points as pts
import pytest
from pyspark.sql import functions as F

from voltpoint import sources as S
from voltpoint.schema import HEADER_LINES, POINT_COLUMNS

T0 = pts.DEFAULTS["epoch_ns"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*POINT_COLUMNS).collect())


def test_parquet_round_trip(spark, tmp_path):
    data = [{"epoch_ns": T0 + i * 40_000_000_000_000, "alt": float(i)} for i in range(20)]
    data += [{"epoch_ns": None}, {"lat": None, "number_stations": None}, {"epoch_ns": -1}]
    points = pts.frame(spark, data)
    path = str(tmp_path / "p")
    staged = S.stage(points, path)
    assert rows(staged) == rows(points)
    folders = {p.name for p in Path(path).iterdir() if p.is_dir()}
    assert {"file_day=2023-11-14", "file_day=1969-12-31", "file_day=__HIVE_DEFAULT_PARTITION__"} <= folders
    S.write_parquet(points.limit(1), path)
    assert S.read_staged(spark, path).count() == 1
    S.write_parquet(points.limit(2), path, mode="append", cluster_days=True, rows_per_file=1)
    assert S.read_staged(spark, path).count() == 3


def test_dat_round_trip(spark, tmp_path):
    data = [
        {"epoch_ns": T0 + 123_456_789_000, "alt": 0.1, "chi": 1e-7, "pdb": -0.5, "number_stations": 31},
        {"epoch_ns": T0 + 86_400_000_000_000, "lat": None, "lon": float("nan"), "alt": 1e10},
        {"number_stations": 32, "alt": 12.345678},
        {"number_stations": 0, "chi": None},
        {"number_stations": None, "pdb": None, "alt": None},
        {"epoch_ns": None},
    ]
    points = pts.frame(spark, data)
    for zipped in (False, True):
        path = str(tmp_path / f"z{zipped}")
        names = S.write_dat(points, path, gzip=zipped)
        assert all(n.endswith(".dat.gz" if zipped else ".dat") for n in names)
        assert not list(Path(path).glob("_staging*"))
        back = S.read_points(spark, path)

        def near(df):
            us = (F.col("epoch_ns") / 1000).cast("decimal(20,0)")
            return Counter(repr(tuple(r)) for r in df.select(us, *POINT_COLUMNS[1:]).collect())

        assert near(back) == near(points)


def test_every_file_has_its_header_first(spark, tmp_path):
    day = datetime.date(2024, 2, 29)
    lines = spark.range(1000).select(F.lit(day).alias("file_day"), F.col("id").cast("string").alias("line"))
    path = tmp_path / "d"
    names = S.write_dat_lines(lines.repartition(4), str(path), gzip=True, cluster_days=False)
    # One busy day stays spread over the input tasks.
    assert len(names) == 4
    body = []
    for name in names:
        assert "_240229_" in name
        text = gzip.decompress(next(path.rglob(name)).read_bytes()).decode().splitlines()
        assert all("header line" in line for line in text[:HEADER_LINES])
        assert not any("header line" in line for line in text[HEADER_LINES:])
        body += text[HEADER_LINES:]
    assert sorted(map(int, body)) == list(range(1000))
    assert S.read_lines(spark, str(path)).count() == 1000


def test_a_busy_day_is_split_after_days_are_brought_together(spark, conf, tmp_path):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4096")
    busy, quiet = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    day = F.when(F.col("id") % 50 == 0, F.lit(quiet)).otherwise(F.lit(busy))
    lines = spark.range(0, 20000, 1, 8).select(day.alias("file_day"), F.col("id").cast("string").alias("line"))
    names = S.write_dat_lines(lines, str(tmp_path / "d"))
    days = Counter(name.split("_")[2] for name in names)
    assert days["240101"] > 1 and days["240102"] >= 1
    back = S.read_lines(spark, str(tmp_path / "d"))
    assert back.count() == 20000 and back.select("line").distinct().count() == 20000


def test_order_within_a_file_is_kept(spark, tmp_path):
    day = datetime.date(2024, 2, 29)
    lines = spark.range(0, 500, 1, 1).select(F.lit(day).alias("file_day"), F.col("id").cast("string").alias("line"))
    (name,) = S.write_dat_lines(lines, str(tmp_path / "d"), cluster_days=False)
    text = next((tmp_path / "d").rglob(name)).read_text().splitlines()[HEADER_LINES:]
    assert text == [str(i) for i in range(500)]


def test_days_outside_the_name_format_are_refused(spark, tmp_path):
    lines = spark.createDataFrame([(datetime.date(1999, 1, 1), "x")], "file_day date, line string")
    with pytest.raises(Exception, match="two year digits"):
        S.write_dat_lines(lines, str(tmp_path / "d"))


def test_exports_add_up(spark, tmp_path):
    lines = spark.createDataFrame([(datetime.date(2024, 1, 1), "x")], "file_day date, line string").coalesce(1)
    for _ in range(2):
        S.write_dat_lines(lines, str(tmp_path / "d"), cluster_days=False)
    assert S.read_lines(spark, str(tmp_path / "d")).count() == 2


def test_a_failed_export_leaves_the_target_as_it_was(spark, tmp_path):
    good = spark.createDataFrame([(datetime.date(2024, 1, 1), "x")], "file_day date, line string")
    S.write_dat_lines(good, str(tmp_path / "d"))
    before = sorted(str(p) for p in (tmp_path / "d").rglob("*"))
    bad = spark.range(0, 1000, 1, 4).select(
        F.lit(datetime.date(2024, 1, 2)).alias("file_day"),
        F.when(F.col("id") == 999, F.raise_error(F.lit("half-way"))).otherwise("y").alias("line"),
    )
    with pytest.raises(Exception, match="half-way"):
        S.write_dat_lines(bad, str(tmp_path / "d"), cluster_days=False)
    assert sorted(str(p) for p in (tmp_path / "d").rglob("*")) == before


def test_more_stations_than_bits_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="32 bits"):
        S.write_dat(pts.frame(spark, [{"number_stations": 33}]), str(tmp_path / "d"))


def test_one_shuffle_and_no_window(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    plans = []
    write = DataFrameWriter.text

    def spy(writer, *args, **options):
        plans.append(pts.plan_of(writer._df))
        return write(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", spy)
    S.write_dat(pts.frame(spark, [{}]), str(tmp_path / "d"))
    (plan,) = plans
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Window" not in plan


def test_clustering_needs_adaptive_execution(spark, conf, tmp_path):
    conf("spark.sql.adaptive.enabled", "false")
    with pytest.raises(ValueError, match="adaptive"):
        S.write_parquet(pts.frame(spark, [{}]), str(tmp_path / "p"))
    S.write_parquet(pts.frame(spark, [{}]), str(tmp_path / "p"), cluster_days=False)


def test_days_of_extreme_times(spark, tmp_path):
    extreme = pts.frame(spark, [{"epoch_ns": -(2**63)}, {"epoch_ns": 2**63 - 1}])
    staged = S.stage(extreme, str(tmp_path / "p"))
    assert sorted(str(r.file_day) for r in staged.collect()) == ["1677-09-21", "2262-04-11"]
