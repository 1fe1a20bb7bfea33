"""Line parsing: dirty text gives NULL, never an error or a wrong value."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from voltpoint import functions as P
from voltpoint.schema import POINT_COLUMNS

DAY = datetime.date(2023, 5, 17)
GOOD = "72000.123456789 33.5 -101.2 8500 0.9 12.3 0x3e6"
GOOD_POINT = (1684353600123456768, 33.5, -101.2, 8.5, 0.9, 12.3, 7)


def parse(spark, *lines, day=DAY):
    rows = spark.createDataFrame([(i, day, line) for i, line in enumerate(lines)], "i int, file_day date, line string")
    return [tuple(r[c] for c in POINT_COLUMNS) for r in P.parse_lines(rows).orderBy("i").collect()]


def same(got, want):
    return got == pytest.approx(want, rel=1e-6) if None not in want else got == want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_lines(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    good, cr, extra, spaces, bad_time, empty, short, blank = parse(
        spark,
        GOOD,
        GOOD + "\r",
        GOOD + " 5 extra 9d",
        "   " + GOOD.replace(" ", "       ") + "  ",
        GOOD.replace("72000.123456789", "x"),
        "",
        "  12.5 33.5",
        "   ",
    )
    assert good[0] == GOOD_POINT[0] and good[6] == 7
    assert good == pytest.approx(GOOD_POINT)
    assert cr == good and extra == good and spaces == good
    assert bad_time == (None, *good[1:])
    assert empty == (None,) * 7 and blank == (None,) * 7
    assert short[0] is not None and short[1] == 33.5 and short[2:] == (None,) * 5


def test_foreign_number_syntax_is_null_on_full_and_short_lines(spark):
    full, last, hexa, infinite = parse(
        spark,
        "1.5d 33.5f -101.2 0x1p3 0.9F 12.3 0x3e6",
        "12.5 33.5f",
        "1.5 0x1p3 -101.2 8500 0.9 12.3 0x3e6",
        "1.5 inf -101.2 8500 nan -inf 0x3e6",
    )
    assert full[0] is None and full[1] is None and full[3] is None and full[4] is None
    assert full[2] == pytest.approx(-101.2) and full[5] == pytest.approx(12.3) and full[6] == 7
    assert last[1] is None
    assert hexa[1] is None and hexa[6] == 7
    assert infinite[1] == float("inf") and infinite[4] != infinite[4] and infinite[5] == -float("inf")


def test_time_out_of_range_and_day_unknown_are_null(spark):
    assert parse(spark, "1e30 33.5")[0][0] is None
    assert parse(spark, "nan 33.5")[0][0] is None
    assert parse(spark, GOOD, day=None)[0][0] is None
    assert parse(spark, GOOD, day=None)[0][6] == 7


MASKS = (
    "0x3e6 0X3E6 0b101 -0x1 +5 5 1e3 7.6 7.5 8.5 -7.5 -1 0xffffffff 0x7fffffff 0x00000003e6 3e6zz zz 0x 0xzz "
    "99999999999 2147483647.6 nan inf 0x123456789 0xffffffffffffffffff 0b2 7f 1d2"
).split()
NUMBERS = (
    "3.5f 3.5d 3.5F 3.5D 1e300 1e39 inf -inf +inf Infinity nan NaN 0x1p3 0X1P3 .5 5. +5 1e 1e5 1E-5 --5 1,5 "
    "infinit 1d5 f d x - + e5 -0.0 0 00012.50 1e400 4.9e-324 33.123456789012345"
).split()


def test_casts_agree_with_the_sql_engine(spark):
    con = duckdb.connect()
    texts = [*MASKS, *NUMBERS, "", "1 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        P.to_int(F.col("t")).alias("i"),
        P.station_count(F.col("t")).alias("n"),
        P.to_double(F.col("t")).alias("d"),
        P.to_float(F.col("t")).alias("f"),
    )
    for row in rows.collect():
        want = con.execute(
            "SELECT TRY_CAST($1 AS INTEGER), CAST(bit_count(TRY_CAST($1 AS INTEGER)) AS INTEGER), "
            "TRY_CAST($1 AS DOUBLE), TRY_CAST($1 AS FLOAT)",
            [row.t],
        ).fetchone()
        assert repr((row.i, row.n, row.d, row.f)) == repr(want), row.t


def test_tokens(spark):
    rows = spark.createDataFrame([("  a  b     c ",), ("",), ("   ",), (None,)], "line string")
    got = [r.t for r in rows.select(P.split_spaces(F.col("line")).alias("t")).collect()]
    assert got == [["a", "b", "c"], [""], [""], None]


@pytest.mark.parametrize(
    ("path", "matches", "day"),
    [
        ("file:/x/LYLOUT_230517_000000_0600.dat", True, "2023-05-17"),
        ("LYLOUT_230517_000000_0600.dat.gz", True, "2023-05-17"),
        ("a/b_c/LMA_7_230517_1_2.dat", True, "2023-05-17"),
        ("LYLOUT_23051799_0_1.dat", True, "2023-05-17"),
        ("LYLOUT_239917_000000_0600.dat", True, None),
        ("LYLOUT_2305_000000_0600.dat", True, None),
        ("LYLOUT_230517_000000_0600.dat.bak", False, None),
        ("LYLOUT_230517_000000_0600xdat", False, None),
        ("LYLOUT_230517_0600.dat", False, None),
        ("/_230517_000000_0600.dat", False, None),
        ("x.txt", False, None),
    ],
)
def test_file_names(spark, path, matches, day):
    row = (
        spark.createDataFrame([(path,)], "p string")
        .select(P.file_name_matches(F.col("p")).alias("m"), P.file_day(F.col("p")).cast("string").alias("d"))
        .first()
    )
    assert (row.m, row.d) == (matches, day)


def test_display_timestamp_keeps_microseconds(spark):
    ns = [1684353600123456999, 1684353600123456000, -1, 0]
    rows = spark.createDataFrame([(n,) for n in ns], "ns long")
    got = [r.u for r in rows.select(F.unix_micros(P.timestamp_of_epoch_ns(F.col("ns"))).alias("u")).collect()]
    assert got == [n // 1000 for n in ns]


def test_fixed_decimals_round_as_c_does(spark):
    import numpy as np

    values = [0.0078125, 0.0234375, 1.5, -101.8992, 2.6e15, 1e-7, 123456.789, -0.5, 0.1]
    values = [float(np.float32(v)) for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "v float")
    got = [r.t for r in rows.select(P.fixed_decimals(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.6f}" for v in values]
