"""Reading files: header position, names, compression, both scan paths."""

import gzip
from collections import Counter

import pytest
from pyspark.errors import PythonException

from voltpoint import sources as S
from voltpoint.schema import HEADER_LINES

STREAM = {"whole_file_bytes": -1, "whole_gzip_bytes": -1}
HEADER = "".join(f"header {i}\n" for i in range(HEADER_LINES))
GOOD = " 1.5 33.5 -101.2 8500 0.9 12.3 0x3e6"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text, newline="")
    return str(path)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    put(d, "LYLOUT_230517_000000_0600.dat", HEADER + "a\nb\n\nc\n")
    put(d, "LYLOUT_230518_000000_0600.dat.gz", HEADER + "d\n\ne")
    put(d, "LYLOUT_230519_000000_0600.dat", HEADER + "f\r\ng\r\n")
    put(d, "LYLOUT_230520_000000_0600.dat", "only\nsome\nlines\n")
    put(d, "LYLOUT_230521_000000_0600.dat", "")
    put(d, "LYLOUT_230522_000000_0600.dat", HEADER)
    put(d, "LYLOUT_230523_000000_0600.dat", HEADER + "\n\n")
    put(d, "LYLOUT_239917_000000_0600.dat", HEADER + 'h | "i" , é\n')
    put(d, "LYLOUT_230517_000000_0600.dat.bak", HEADER + "no\n")
    put(d, "LYLOUT_230517_0600.dat", HEADER + "no\n")
    put(d, "_230517_000000_0600.dat", HEADER + "no\n")
    put(d, "x.txt", HEADER + "no\n")
    return str(d)


WANT = Counter(
    {
        ("2023-05-17", "a"): 1,
        ("2023-05-17", "b"): 1,
        ("2023-05-17", ""): 1,
        ("2023-05-17", "c"): 1,
        ("2023-05-18", "d"): 1,
        ("2023-05-18", ""): 1,
        ("2023-05-18", "e"): 1,
        ("2023-05-19", "f\r"): 1,
        ("2023-05-19", "g\r"): 1,
        ("2023-05-23", ""): 2,
        (None, 'h | "i" , é'): 1,
    }
)


def bag(lines):
    return Counter((r.file_day and str(r.file_day), r.line) for r in lines.collect())


@pytest.mark.parametrize("options", [{}, STREAM], ids=["whole", "streamed"])
def test_header_is_skipped_per_file(spark, folder, options):
    assert bag(S.read_lines(spark, folder, **options)) == WANT


@pytest.mark.parametrize("options", [{}, STREAM], ids=["whole", "streamed"])
def test_path_lists_and_repeats(spark, folder, options):
    path = f"{folder}/LYLOUT_230517_000000_0600.dat"
    assert S.read_lines(spark, [path, path, f"{folder}/x.txt"], **options).count() == 4


def test_nested_folders_and_overlapping_paths(spark, tmp_path):
    d = tmp_path / "year"
    put(d, "LYLOUT_230517_000000_0600.dat", HEADER + "a\n")
    put(d / "05", "LYLOUT_230518_000000_0600.dat", HEADER + "b\nc\n")
    inside = put(d / "05" / "19", "LYLOUT_230519_000000_0600.dat.gz", HEADER + "d\n")
    for options in ({}, STREAM):
        assert S.read_lines(spark, str(d), **options).count() == 4
        lines = S.read_lines(spark, [inside, f"{d}/05/", str(d)], **options)
        assert sorted(r.line for r in lines.collect()) == ["a", "b", "c", "d"]
    assert S.list_files(spark, str(d)).count() == 3


def test_listing_is_done_once_a_scan(spark, tmp_path):
    from voltpoint.sources import lylout

    d = tmp_path / "in"
    put(d, "LYLOUT_230517_000000_0600.dat", HEADER + "a\n")
    # Two scans, each with the paths it was given and one file index.
    text = S.read_lines(spark, [str(d), str(d)])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan text") == 2 and text.count("InMemoryFileIndex(1 paths)") == 2
    assert lylout._path_list(["/a/b/", "/a", "/ab", "/a"]) == ["/a", "/ab"]


@pytest.mark.parametrize("options", [{}, STREAM], ids=["whole", "streamed"])
def test_odd_days_and_bytes_are_treated_alike(spark, tmp_path, options):
    d = tmp_path / "odd"
    put(d, "LYLOUT_23051_000000_0600.dat", HEADER + "five\n")
    put(d, "LYLOUT_2305_000000_0600.dat", HEADER + "four\n")
    put(d, "LYLOUT_230530_000000_0600.dat", "")
    (d / "LYLOUT_230531_000000_0600.dat").write_bytes(HEADER.encode() + b"a\xff\xe2\x82\nb\xc3\n")
    assert bag(S.read_lines(spark, str(d), **options)) == Counter(
        {
            ("2023-05-01", "five"): 1,
            (None, "four"): 1,
            ("2023-05-31", "a\ufffd\ufffd"): 1,
            ("2023-05-31", "b\ufffd"): 1,
        }
    )


def test_report_below_a_folder_with_a_blank(spark, tmp_path):
    d = tmp_path / "with blank"
    put(d, "LYLOUT_230517_000000_0600.dat", HEADER + f"{GOOD}\n")
    report = S.load_report(S.read_points(spark, str(d)), S.list_files(spark, str(d)))
    assert [r.rows for r in report.collect()] == [1]


def test_both_paths_share_the_files(spark, folder):
    # Files of up to 500 bytes are read whole, the others as streams.
    assert bag(S.read_lines(spark, folder, whole_file_bytes=500, whole_gzip_bytes=-1)) == WANT


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_large_files_are_split(spark, conf, tmp_path, batch):
    conf("spark.sql.files.maxPartitionBytes", "1200")
    conf("spark.sql.files.openCostInBytes", "10")
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    d = tmp_path / "big"
    want = Counter()
    for day in (10, 11, 12):
        lines = [f"{day} {i}" for i in range(day * 40)]
        put(d, f"LYLOUT_2305{day}_000000_0600.dat", HEADER + "\n".join(lines) + "\n")
        put(d, f"LYLOUT_2306{day}_000000_0600.dat.gz", HEADER + "\n".join(lines))
        want.update((f"2023-05-{day}", line) for line in lines)
        want.update((f"2023-06-{day}", line) for line in lines)
    lines = S.read_lines(spark, str(d), **STREAM)
    assert lines.rdd.getNumPartitions() > 6
    assert bag(lines) == want
    assert bag(S.read_lines(spark, str(d))) == want


def test_header_past_the_first_split_is_an_error(spark, conf, tmp_path):
    conf("spark.sql.files.maxPartitionBytes", "100")
    conf("spark.sql.files.openCostInBytes", "10")
    put(tmp_path / "s", "LYLOUT_230517_000000_0600.dat", HEADER + "a\n" * 10)
    with pytest.raises(PythonException, match="maxPartitionBytes"):
        S.read_lines(spark, str(tmp_path / "s"), **STREAM).collect()


def test_points_and_report(spark, tmp_path):
    d = tmp_path / "p"
    put(d, "LYLOUT_230517_000000_0600.dat", HEADER + f"{GOOD}\n{GOOD}\nx\n\n")
    put(d, "LYLOUT_230518_000000_0600.dat.gz", HEADER + GOOD)
    put(d, "LYLOUT_230519_000000_0600.dat", HEADER)
    put(d, "notes.txt", "hello")
    points = S.read_points(spark, str(d))
    report = S.load_report(points, S.list_files(spark, str(d)))
    got = {
        r.file_path.rsplit("/", 1)[1]: (r.matched, r.rows, r.null_epoch_ns, r.null_number_stations)
        for r in report.collect()
    }
    assert got == {
        "LYLOUT_230517_000000_0600.dat": (True, 4, 2, 2),
        "LYLOUT_230518_000000_0600.dat.gz": (True, 1, 0, 0),
        "LYLOUT_230519_000000_0600.dat": (True, 0, 0, 0),
        "notes.txt": (False, 0, 0, 0),
    }
    assert S.load_report(points).count() == 2


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        S.read_points(spark, str(tmp_path / "nothing")).count()


def test_small_files_stay_in_the_jvm(spark, folder):
    from voltpoint.sources import lylout

    small = lylout._size_is_small(lylout.WHOLE_FILE_BYTES, lylout.WHOLE_GZIP_BYTES)
    plan = lylout._whole_file_lines(spark, [folder], small, HEADER_LINES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in text and "Exchange" not in text
    assert text.count("split(") == 1


@pytest.mark.parametrize("limit", [-1, 1 << 20])
def test_no_file_is_opened_by_both_scans(spark, folder, limit):
    from voltpoint.sources import lylout

    small = lylout._size_is_small(limit, limit)
    whole = lylout._whole_file_lines(spark, [folder], small, HEADER_LINES)
    streamed = lylout._streamed_lines(spark, [folder], small, HEADER_LINES)
    idle, busy = (whole, streamed) if limit < 0 else (streamed, whole)
    assert idle.rdd.getNumPartitions() == 0 and busy.rdd.getNumPartitions() > 0


def test_generated_code_is_small_enough_to_compile(spark, folder):
    # The JVM does not compile methods of more than 8000 bytes.
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    plan = S.read_points(spark, folder)._jdf.queryExecution().executedPlan()
    stages = getattr(debug, "MODULE$").codegenStringSeq(plan).iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) < 8000
