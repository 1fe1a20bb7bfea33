"""Flash groups and connected components against brute force."""

import random

import points as pts
import pytest
from pyspark.sql import functions as F

from voltpoint import operators as O

SCALE = {"km_per_lon": 100.0, "km_per_lat": 111.0}
SECOND = 1_000_000_000


def brute(rows, gap, reach):
    """rows: id -> (t, x, y, z); the smallest id of each one's component."""
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = rows[i], rows[j]
            d = [p - q for p, q in zip(a[1:], b[1:])]
            if abs(a[0] - b[0]) <= gap and d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= reach * reach:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in rows}


def placed(spark, rows):
    frame = pts.frame(spark, [dict(zip(("epoch_ns", "lon", "lat", "alt"), r)) for r in rows])
    return frame.coalesce(1).withColumn("id", F.monotonically_increasing_id())


def check(spark, rows, gap, reach):
    frame = placed(spark, rows)
    want = {}
    for r in frame.collect():
        if None not in (r.epoch_ns, r.lon, r.lat, r.alt) and r.lon == r.lon and abs(r.lat) < 1e9:
            want[r.id] = (r.epoch_ns, r.lon * 100.0, r.lat * 111.0, r.alt)
    want = brute(want, gap, reach)
    got = {r.id: r.flash_id for r in O.flash_groups(frame, "id", max_gap_ns=gap, max_km=reach, **SCALE).collect()}
    assert got == {i: want.get(i) for i in range(len(rows))}
    return want


def scattered(seed, n, width):
    rng = random.Random(seed)
    return [(rng.randrange(40) * SECOND // 2, -101 + rng.random() * width, 33 + rng.random() * width, rng.random() * 10) for _ in range(n)]


@pytest.mark.parametrize("width, reach", [(0.5, 4.0), (0.1, 2.0), (2.0, 30.0)])
def test_scattered_points(spark, width, reach):
    found = check(spark, scattered(int(reach), 250, width), SECOND, reach)
    assert 1 < len(set(found.values())) < 250


def test_missing_and_extreme_values(spark):
    same = (0, -101.0, 33.0, 5.0)
    far = [(-(2**63) + 1, -101.0, 33.0, 5.0), (2**63 - 1, -101.0, 33.0, 5.0)]
    missing = [(None, -101.0, 33.0, 5.0), (0, None, 33.0, 5.0), (0, float("nan"), 33.0, 5.0), (0, -101.0, 1e30, 5.0), (0, -101.0, 33.0, None)]
    check(spark, [same, same, *far, *missing, (SECOND, -101.0, 33.0, 6.0), (2 * SECOND + 1, -101.0, 33.0, 6.0)], SECOND, 1.0)


def test_links_at_the_limits(spark):
    # Exactly the gap and the reach away, and a little more.
    rows = [(0, 0.0, 0.0, 0.0), (SECOND, 0.0, 0.0, 2.0), (2 * SECOND + 1, 0.0, 0.0, 2.0), (0, 0.0, 0.0, -2.0), (0, 0.0, 0.0, -4.000001)]
    found = check(spark, rows, SECOND, 2.0)
    assert set(found.values()) == {0, 2, 4}


def test_no_points(spark):
    assert O.flash_groups(placed(spark, []), "id", max_gap_ns=1, max_km=1.0, **SCALE).count() == 0


def test_crowded_cells_are_halved(spark, monkeypatch):
    from voltpoint.operators import flashes

    monkeypatch.setattr(flashes, "DIRECT_PAIRS", 4)
    rng = random.Random(1)
    clump = lambda at, n: [(rng.randrange(SECOND // 4), at + rng.random() * 0.01, 33 + rng.random() * 0.01, rng.random()) for _ in range(n)]
    # Neighbouring clumps, near enough to be asked and not always to be linked.
    check(spark, clump(-101.0, 60) + clump(-100.975, 60) + clump(-100.93, 40), SECOND, 2.0)
    check(spark, clump(-101.0, 60) + clump(-100.99, 60), SECOND, 1.5)


def test_a_cell_with_a_third_of_the_points(spark):
    """Two neighbouring cells hold 20,000 points each: 4e8 pairs, none is listed."""
    crowd = spark.range(60_000).select(
        "id",
        (F.col("id") * 10_007 % SECOND).alias("epoch_ns"),
        F.when(F.col("id") % 3 == 0, -101.0 + F.col("id") / 6e7).when(F.col("id") % 3 == 1, -100.984 + F.col("id") / 6e7).otherwise(-90.0 + F.col("id") / 100).alias("lon"),
        F.lit(33.0).alias("lat"),
        F.lit(5.0).alias("alt"),
    )
    found = O.flash_groups(crowd, "id", max_gap_ns=2 * SECOND, max_km=2.0, **SCALE).groupBy("flash_id").count()
    sizes = {r.flash_id: r["count"] for r in found.collect()}
    assert sizes[0] == 40_000 and sum(sizes.values()) == 60_000


def test_components(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1001 + i) for i in range(300)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges = path + star + loose + [(5, 5)]
    found = {r.node: r.root for r in O.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if n != r}
    assert O.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
