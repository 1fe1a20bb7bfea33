"""Parquet and text export of points.

The text export re-creates the input format: ``<word>_<yymmdd>_<n>_<n>.dat``
files with a fixed number of header lines. It is a layout of our own that
`read_points` reads back; no other program's dialect is claimed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint.functions.parse import exact_difference, floor_div
from voltpoint.schema import HEADER_LINES, NANOS_PER_SECOND, SECONDS_PER_DAY

NANOS_PER_DAY = SECONDS_PER_DAY * NANOS_PER_SECOND
_NO_DAY = "000000"  # no valid date, so it reads back as NULL


def _with_file_day(points: DataFrame) -> DataFrame:
    day = F.date_from_unix_date(floor_div(F.col("epoch_ns"), NANOS_PER_DAY).cast("int"))
    if "file_day" in points.columns:
        day = F.coalesce(F.col("file_day"), day)
    return points.withColumn("file_day", day)


def _by_day(rows: DataFrame) -> DataFrame:
    """Bring a day's rows together; adaptive execution splits a large day."""
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled", "true").lower() != "true":
        raise ValueError(
            "spark.sql.adaptive.enabled is off, so a busy day would be one task: "
            "turn it on, or pass cluster_days=False"
        )
    return rows.hint("rebalance", "file_day")


def write_parquet(
    points: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    cluster_days: bool = True,
    rows_per_file: int = 0,
) -> None:
    """Parquet, one folder per day.

    A task of a text scan holds files of many days and would write a small file
    for each, so adaptive execution first brings a day's rows together, merging
    small days and splitting large ones by size. Leave ``cluster_days`` out for
    rows that are in day order already: nothing is shuffled then.
    """
    points = _with_file_day(points)
    if cluster_days:
        points = _by_day(points)
    writer = points.write.mode(mode).partitionBy("file_day")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def point_lines(points: DataFrame) -> DataFrame:
    """``(file_day, line)``: one text line per point.

    A NULL is written as '-', which no column parses. Masks are not part of a
    point, so the mask written has as many bits set as there were stations; more
    than 32 do not fit the format and raise.
    """

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("-"))

    day_start = F.unix_date("file_day").cast("bigint") * F.lit(NANOS_PER_DAY)
    rows = _with_file_day(points).withColumn("offset", exact_difference(F.col("epoch_ns"), day_start))
    seconds = F.concat(
        F.when(F.col("offset") < 0, "-").otherwise(""),
        F.expr(f"abs(offset) div {NANOS_PER_SECOND}").cast("string"),
        F.lit("."),
        F.lpad(F.expr(f"abs(offset) % {NANOS_PER_SECOND}").cast("string"), 9, "0"),
    )
    stations = F.col("number_stations").cast("int")
    bits = F.expr("shiftleft(1L, cast(number_stations as int)) - 1")
    # 32 bits do not fit a signed hexadecimal mask; -1 has them all.
    mask = (
        F.when(stations > 32, F.raise_error(F.lit("a mask has 32 bits: more stations than that cannot be written")))
        .when(stations == 32, "-1")
        .otherwise(F.concat(F.lit("0x"), F.lower(F.hex(bits))))
    )
    return rows.select(
        "file_day",
        F.concat_ws(
            " ",
            text(seconds),
            text(F.col("lat")),
            text(F.col("lon")),
            text(F.col("alt").cast("double") * 1000),
            text(F.col("chi")),
            text(F.col("pdb")),
            text(mask),
        ).alias("line"),
    )


def write_dat(points: DataFrame, path: str, **options) -> list[str]:
    """Points -> text files below ``path``; returns the file names."""
    return write_dat_lines(point_lines(points), path, **options)


def _with_headers(header: str):
    """Puts the header before the first line of each day of a task, and numbers
    the lines; holds one Arrow batch and the days' names.

    Self-contained on purpose: it is shipped to the tasks by value."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        seen, count = set(), 0
        for batch in batches:
            day, line = batch.column("day").cast(pa.string()), batch.column("line").cast(pa.string())
            for name in day.unique().to_pylist():
                if name not in seen:
                    seen.add(name)
                    first = pc.index(day, name).as_py()
                    is_first = pc.equal(pa.array(range(batch.num_rows)), first)
                    line = pc.replace_with_mask(line, is_first, pa.scalar(f"{header}\n{line[first].as_py()}"))
            seq = pa.array(range(count, count + batch.num_rows), pa.int64())
            count += batch.num_rows
            yield pa.RecordBatch.from_arrays([day, seq, line], names=["day", "seq", "value"])

    return add


def write_dat_lines(
    lines: DataFrame,
    path: str,
    *,
    word: str = "LYLOUT",
    gzip: bool = False,
    cluster_days: bool = True,
) -> list[str]:
    """``(file_day, line)`` rows -> ``<word>_<part>_<yymmdd>_000000_86400.dat``
    in a new folder ``export-<id>`` below ``path``; returns the file names.

    A file holds one day's lines of one input task, so a busy day becomes many
    files of bounded size rather than one file from one task. ``cluster_days``
    first lets adaptive execution bring a day's rows together (and split large
    days); leave it out for rows already in file order.

    The folder appears at once when all is written; where anything fails,
    nothing of it is left. Each export adds its own folder to earlier ones.
    """
    spark = lines.sparkSession
    if cluster_days:
        lines = _by_day(lines)
    year = F.year("file_day")
    day = (
        F.when(F.col("file_day").isNull(), _NO_DAY)
        .when(year.between(2000, 2099), F.date_format("file_day", "yyMMdd"))
        .otherwise(F.raise_error(F.lit("the file name has two year digits: 2000 to 2099 only")))
    )
    header = "\n".join(f"{word} header line {i + 1} of {HEADER_LINES}" for i in range(HEADER_LINES))
    rows = lines.select(day.alias("day"), F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.mapInArrow(_with_headers(header), "day string, seq bigint, value string")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    export = uuid.uuid4().hex
    staging = hadoop.Path(root, f"_staging-{export}")
    try:
        (
            rows.sortWithinPartitions("day", "seq")
            .select("day", "value")
            .write.partitionBy("day")
            .option("compression", "gzip" if gzip else "none")
            .text(f"{staging.toString()}/parts")
        )
        names = _name_files(hadoop, fs, staging, word, ".dat.gz" if gzip else ".dat")
        # One rename publishes the whole folder.
        if not fs.rename(hadoop.Path(staging, "named"), hadoop.Path(root, f"export-{export}")):
            raise OSError(f"the export cannot be published below {path}")
    finally:
        fs.delete(staging, True)
    return names


def _name_files(hadoop, fs, staging, word: str, suffix: str) -> list[str]:
    """Give finished part files their names, still inside the staging folder."""
    target = hadoop.Path(staging, "named")
    fs.mkdirs(target)

    def parts():
        found = fs.listFiles(hadoop.Path(staging, "parts"), True)
        while found.hasNext():
            source = found.next().getPath()
            match = re.search(r"/day=(\d+)/part-(\d+)-[^/]*$", source.toString())
            if match:
                yield source, f"{word}_{int(match[2]):06d}_{match[1]}_000000_86400{suffix}"

    def move(item) -> str:
        source, name = item
        if not fs.rename(source, hadoop.Path(target, name)):
            raise OSError(f"{source.toString()} cannot be renamed")
        return name

    names = []
    with ThreadPoolExecutor(16) as pool:
        for some in batched(parts(), 256):
            names += pool.map(move, some)
    return sorted(names)
