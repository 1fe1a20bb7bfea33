"""Distributed read of fixed-header point text files, plain or gzipped.

The header is a fixed number of lines *per file*, while Spark's line reader
knows no line numbers. Two scans over the same paths share the work; each
takes its own files at listing time, so no file is opened twice:

* Small files are read one file per row and split into lines. Everything stays
  in the JVM and Spark packs many files into one task.
* Larger files are read line by line, so a plain file is split over many tasks
  and a gzipped one is streamed. The header is dropped by a helper that keeps
  one line counter per task and passes all later Arrow batches through as they
  are; it holds one batch at a time whatever the file size.

Names, days and bytes are treated by the same expressions in both scans: bytes
that are not UTF-8 become U+FFFD. Folders are read with all folders below them.
Spark's own listing hides files and folders whose name begins with ``_`` or
``.``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint.functions.parse import file_day, file_name_matches, parse_lines
from voltpoint.schema import (
    FILE_NAME_GLOB,
    HEADER_LINES,
    LINE_SCHEMA,
    POINT_COLUMNS,
)

# Largest file that becomes one row: a task needs about eight times as much
# memory while the row is split. Gzip gets a smaller bound as this text inflates
# three- to sixfold; a file that inflates past what a task can hold fails it, it
# is never cut.
WHOLE_FILE_BYTES = 32 << 20
WHOLE_GZIP_BYTES = 4 << 20

Paths = str | Iterable[str]


def _path_list(paths: Paths) -> list[str]:
    """The paths, without repeats and without what lies below another one."""
    if isinstance(paths, str):
        return [paths]
    given = list(dict.fromkeys(p.rstrip("/") or "/" for p in paths))
    return [p for p in given if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in given)]


def _reader(spark: SparkSession):
    return spark.read.option("pathGlobFilter", FILE_NAME_GLOB).option("recursiveFileLookup", True)


def _size_is_small(whole_file_bytes: int, whole_gzip_bytes: int):
    # Only constant file metadata, so Spark applies it while listing files.
    limit = F.when(F.endswith(F.col("_metadata.file_name"), F.lit(".gz")), whole_gzip_bytes)
    return F.col("_metadata.file_size") <= limit.otherwise(whole_file_bytes)


def _whole_file_lines(spark: SparkSession, paths: list[str], is_small, header_lines: int):
    files = (
        _reader(spark)
        .text(paths, wholetext=True)
        .where(is_small)
        .select(F.col("_metadata.file_path").alias("file_path"), "value")
        .where(file_name_matches(F.col("file_path")))
        .select(
            "file_path",
            file_day(F.col("file_path")).alias("file_day"),
            F.split(F.make_valid_utf8("value"), "\n").alias("lines"),
        )
    )
    # The outer form adds no test for an empty array, which would split twice.
    lines = files.select(
        "file_path",
        "file_day",
        F.size("lines").alias("n"),
        F.posexplode_outer("lines").alias("pos", "line"),
    )
    # The newline that ends the last line leaves one empty text behind it.
    is_rest = (F.col("pos") == F.col("n") - 1) & (F.col("line") == "")
    return lines.where((F.col("pos") >= header_lines) & ~is_rest).select(*LINE_SCHEMA.fieldNames())


def _header_dropper(header_lines: int):
    """Arrow batches of one task -> the same batches without header lines.

    Self-contained on purpose: it is shipped to the tasks by value.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        def check_end(key, seen, cut):
            if key is not None and key[1] == 0 and cut and seen < header_lines:
                raise ValueError(
                    f"the header of {key[0]} runs past its first input split; "
                    "raise spark.sql.files.maxPartitionBytes"
                )

        # One run = the lines of one split of one file, always consecutive.
        current, seen, cut = None, 0, False
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            path, start = batch.column("file_path"), batch.column("block_start")

            def key_at(i, path=path, start=start):
                return path[i].as_py(), start[i].as_py()

            bounds = [0, n]
            if key_at(0) != key_at(n - 1) or n > 1 and key_at(0) != current:
                changed = pc.or_(
                    pc.not_equal(path.slice(1), path.slice(0, n - 1)),
                    pc.not_equal(start.slice(1), start.slice(0, n - 1)),
                )
                bounds = [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist()), n]
            for lo, hi in zip(bounds, bounds[1:]):
                key = key_at(lo)
                if key != current:
                    check_end(current, seen, cut)
                    current, seen = key, 0
                    cut = batch.column("cut")[lo].as_py()
                skip = 0
                if key[1] == 0:
                    skip = min(max(header_lines - seen, 0), hi - lo)
                    seen += hi - lo
                if lo + skip < hi:
                    rest = batch.slice(lo + skip, hi - lo - skip)
                    yield rest.select(["file_path", "line"]).cast(
                        pa.schema([("file_path", pa.string()), ("line", pa.string())])
                    )
        check_end(current, seen, cut)

    return drop


def _streamed_lines(spark: SparkSession, paths: list[str], is_small, header_lines: int):
    split_end = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")
    lines = (
        _reader(spark)
        .text(paths, lineSep="\n")
        .where(~is_small & file_name_matches(F.col("_metadata.file_path")))
        .select(
            F.make_valid_utf8("value").alias("line"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            (split_end < F.col("_metadata.file_size")).alias("cut"),
        )
    )
    kept = lines.mapInArrow(_header_dropper(header_lines), "file_path string, line string")
    return kept.select("file_path", file_day(F.col("file_path")).alias("file_day"), "line")


def read_lines(
    spark: SparkSession,
    paths: Paths,
    *,
    header_lines: int = HEADER_LINES,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    whole_gzip_bytes: int = WHOLE_GZIP_BYTES,
) -> DataFrame:
    """``(file_path, file_day, line)`` of all data lines of the given files,
    folders (with those below them) or globs. Files whose name does not match
    are skipped; a file given twice, or below a folder given too, is read once."""
    paths = _path_list(paths)
    is_small = _size_is_small(whole_file_bytes, whole_gzip_bytes)
    return _whole_file_lines(spark, paths, is_small, header_lines).unionByName(
        _streamed_lines(spark, paths, is_small, header_lines)
    )


def read_points(spark: SparkSession, paths: Paths, **options) -> DataFrame:
    """``(file_path, file_day, <point columns>)``, one row per data line."""
    return parse_lines(read_lines(spark, paths, **options))


def list_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file_path, file_size, matched, file_day)`` of every file found,
    skipped ones included. File contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # The same form of path as the lines have.
    files = reader.load(_path_list(paths)).select(F.col("_metadata.file_path").alias("file_path"), "length")
    return files.select(
        "file_path",
        F.col("length").alias("file_size"),
        file_name_matches(F.col("file_path")).alias("matched"),
        file_day(F.col("file_path")).alias("file_day"),
    )


def load_report(points: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows and unreadable values per file; with ``files`` (see `list_files`)
    also the files that gave no row, skipped ones included."""

    def nulls(name: str):
        return F.count_if(F.col(name).isNull()).alias(f"null_{name}")

    report = points.groupBy("file_path").agg(
        F.count("*").alias("rows"), *[nulls(c) for c in POINT_COLUMNS]
    )
    if files is None:
        return report
    counts = [c for c in report.columns if c != "file_path"]
    return files.join(report, "file_path", "left").na.fill(0, counts)
