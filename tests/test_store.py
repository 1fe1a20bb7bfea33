"""Versioned loads, clustered tables, delimited records and the cube."""

import datetime
from collections import Counter

import points as pts
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voltpoint import operators as O
from voltpoint import sources as S
from voltpoint.plans import adapter
from voltpoint.plans.queries import STORED_DAYS
from voltpoint.schema import HEADER_LINES, POINT_COLUMNS, Thresholds
from voltpoint.sources import tables

HEADER = "h\n" * HEADER_LINES


def day_file(folder, day, lines, odd=""):
    path = folder / f"LYLOUT_{day}_{odd}000000_0600.dat"
    path.write_text(HEADER + "".join(f"{line}\n" for line in lines))
    return str(path)


def line(second, alt=5000):
    return f"{second}.5 33.5 -101.5 {alt} 1.0 10.0 0xff"


def rows(frame):
    return Counter(tuple(r) for r in frame.select(*POINT_COLUMNS).collect())


@pytest.fixture
def store(spark, tmp_path):
    return S.PointStore(spark, str(tmp_path / "store"))


def test_appended_twice_is_there_once(spark, store, tmp_path):
    root = tmp_path / "in"
    folder = root / "a b [1]"
    folder.mkdir(parents=True)
    one = day_file(folder, "240101", [line(1), line(2)])
    two = day_file(folder, "240102", [line(3)])
    assert store.version() == 0
    with pytest.raises(LookupError):
        store.points()
    assert store.append(one.replace("[", "\\[").replace("]", "\\]")) == 1
    for paths in (str(root), [str(root)], str(root)):
        assert store.append(paths) == 2
    assert rows(store.points()) == rows(S.read_points(spark, str(root)))
    assert {r.file_path.rsplit("_", 3)[1]: r.rows for r in store.report().collect()} == {"240101": 2, "240102": 1}
    assert rows(store.points(1)) == rows(S.read_points(spark, str(root)).where("file_day = '2024-01-01'"))
    # A file that has grown is another file; a new load replaces all.
    day_file(folder, "240102", [line(3), line(4)])
    assert store.append(str(root)) == 3 and store.points().count() == 5
    assert store.replace(str(root)) == 4 and store.points().count() == 4
    assert two in [p.replace("%20", " ").replace("%5B", "[").replace("%5D", "]").removeprefix("file://").removeprefix("file:") for p in (r.file_path for r in store.report().collect())]


def test_a_load_that_dies_leaves_the_table(spark, store, tmp_path, monkeypatch):
    folder = tmp_path / "d"
    folder.mkdir()
    day_file(folder, "240101", [line(1)])
    store.replace(str(folder))
    day_file(folder, "240102", [line(2)])
    for step in ("write_parquet", "load_report"):
        with monkeypatch.context() as patch:
            patch.setattr(f"voltpoint.sources.store.{step}", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.append(str(folder))
        assert store.version() == 1 and store.points().count() == 1
    assert store.append(str(folder)) == 2 and store.points().count() == 2


def test_one_of_two_loads_at_a_time_fails(spark, store, tmp_path):
    (tmp_path / "d").mkdir()
    day_file(tmp_path / "d", "240101", [line(1)])
    store.replace(str(tmp_path / "d"))
    with pytest.raises(RuntimeError, match="another load"):
        store._publish([], 0)
    assert store.version() == 1 and store.points().count() == 1


def test_nothing_to_load(spark, store, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "notes.txt").write_text("x")
    assert store.append(str(tmp_path / "d")) == 1
    assert store.points().count() == 0 and store.extent().first().source_count == 0
    assert store.append(str(tmp_path / "d")) == 1


def test_extents_of_days_are_those_of_the_points(spark, sf_dir):
    store = adapter.event_store(spark, sf_dir)
    points = store.points()
    assert store.extent().collect() == O.point_extent(points).collect()
    some = points.where(F.col("file_day").between(*[F.lit(d).cast("date") for d in STORED_DAYS]))
    assert 0 < store.extent(STORED_DAYS).first().source_count == some.count()
    assert store.extent(STORED_DAYS).collect() == O.point_extent(some).collect()


def test_extents_and_reports_read_no_points(spark, sf_dir):
    store = adapter.event_store(spark, sf_dir)
    for frame, folder in ((store.extent(), "extents"), (store.report(), "files")):
        files = frame.inputFiles()
        assert files and all(f"/{folder}/" in f for f in files)
        assert pts.plan_of(frame).count("FileScan") == 1


def test_strict_filters_read_fewer_row_groups(spark, sf_dir, tmp_path):
    points = spark.range(200_000).select(
        (F.rand(1) * 1e15).cast("bigint").alias("epoch_ns"),
        *[(F.rand(i) * 20).cast("float").alias(c) for i, c in enumerate(("lat", "lon", "alt", "chi", "pdb"), 2)],
        F.lit(8).cast("tinyint").alias("number_stations"),
    )
    path = tmp_path / "c"
    staged = S.cluster(points, str(path), group_bytes=16 << 10)
    assert rows(staged.where("alt < 1")) == rows(points.where("alt < 1"))

    def touched(column, low, high):
        found = []
        for file in path.glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            at = meta.schema.to_arrow_schema().get_field_index(column)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                found.append(s.max >= low and s.min <= high)
        return sum(found), len(found)

    for column in ("alt", "lat", "lon"):
        some, every = touched(column, 5, 7)
        # Two of twenty parts; four columns share the order.
        assert every > 100 and some < 0.55 * every
    assert "PushedFilters: [IsNotNull(alt)" in pts.plan_of(staged.where("alt > 5 and alt < 7"))


def test_the_curve_keeps_neighbours_together(spark):
    grid = [{"lon": float(x), "lat": float(y)} for x in range(4) for y in range(4)]
    places = {(r.lon, r.lat): r._curve for r in tables.curve(pts.frame(spark, grid), ["lon", "lat"]).collect()}
    order = sorted(places, key=places.get)
    # The first quarter of the curve is one quarter of the square.
    assert set(order[:4]) == {(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)}
    missing = tables.curve(pts.frame(spark, [{"lon": None}, {"lon": float("nan")}, {}]), ["epoch_ns", "lon", "lat", "alt"])
    assert missing.count() == 3


def test_rejected_records(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,day,x\n1,2024-01-02,1.5\n\n# note\n2,bad,2.5\n3,2024-01-03\n4,2024-01-04,1,9\n")
    got = S.read_delimited(spark, str(tmp_path), "id int, day date, x float", header=True, comment="#")
    found = {r.id: (r.day, r.x, r.rejected) for r in got.collect()}
    day = datetime.date
    assert found == {
        1: (day(2024, 1, 2), 1.5, None),
        2: (None, 2.5, "2,bad,2.5"),
        3: (day(2024, 1, 3), None, "3,2024-01-03"),
        4: (day(2024, 1, 4), 1.0, "4,2024-01-04,1,9"),
    }
    with pytest.raises(ValueError, match="rejected"):
        S.read_delimited(spark, str(tmp_path), "rejected string")


def test_strikes_in_the_workspace(spark, tmp_path):
    from voltpoint import Workspace

    (tmp_path / "s.csv").write_text("1|2.5\n")
    ws = Workspace(spark, view="strike_points")
    ws.use(pts.frame(spark, [{}]))
    ws.load_strikes(str(tmp_path), "id int, x double", delimiter="|")
    ws.use(pts.frame(spark, [{}, {}]))
    assert spark.table("strike_points_strikes").count() == 1 and ws.points().count() == 2
    ws.clear()
    assert not spark.catalog.tableExists("strike_points_strikes") and not spark.catalog.tableExists("strike_points")


def test_cube_counts(spark):
    data = [{"alt": a, "chi": c} for a in (None, float("nan"), -1.0, 0.0, 0.1, 5.0, 19.9, 20.0) for c in (0.0, 0.1, 5.0, None)]
    points = pts.frame(spark, data)
    edges = {"number_stations": [6.0], "alt": [0.0, 10.0, 20.0], "chi": [0.1], "pdb": []}
    sets = {"all": {}, "default": Thresholds(), "tight": {"alt": (0.1, 0.1)}, "none": {"alt": (30.0, None)}, "chi": {"chi": (0.1, None), "alt": (None, 5.0)}}
    cube = O.threshold_cube(points, edges)
    got = {r.thresholds: r.n for r in O.cube_counts(points, cube, edges, sets).collect()}
    # A row without a value in one of the cube's columns is in no set.
    complete = points.where("alt is not null and not isnan(alt) and chi is not null")
    bounds = {k: v.bounds() if isinstance(v, Thresholds) else v for k, v in sets.items()}
    assert got == {k: O.range_filter(complete, b).count() for k, b in bounds.items()}
    with pytest.raises(ValueError, match="lat"):
        O.cube_counts(points, cube, edges, {"x": {"lat": (0, 1)}})
