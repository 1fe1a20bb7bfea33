"""The given ``events`` table seen as points, as text lines and as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint.functions.parse import epoch_ns_of_timestamp
from voltpoint.schema import HEADER_LINES
from voltpoint.sources.export import write_dat_lines
from voltpoint.sources.scratch import scratch_folder
from voltpoint.sources.store import PointStore

# Fixed values of the derivation: a multiplicative hash gives the station mask.
MASK_FACTOR = 2654435761
MASK_SIZE = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mask() -> Column:
    return F.col("event_id") * F.lit(MASK_FACTOR) % F.lit(MASK_SIZE)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and the point columns."""
    number = F.col("event_id").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch_ns_of_timestamp(F.col("ts")).alias("epoch_ns"),
        (F.lit(33.0) + (number % 997).cast("double") / 1000.0).cast("float").alias("lat"),
        (F.lit(-102.0) + (number * 7 % 1009).cast("double") / 1000.0).cast("float").alias("lon"),
        (F.col("value") / 10.0).cast("float").alias("alt"),
        ((F.col("user_id") % 61).cast("double") / 10.0).cast("float").alias("chi"),
        (number % 141 - 70).cast("float").alias("pdb"),
        F.bit_count(_mask()).cast("tinyint").alias("number_stations"),
    )


def dirty_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_points`, some with times as far apart as BIGINT allows, some with a
    latitude of 1e30 or a tiny negative one."""
    number = F.col("event_id")
    time = F.when(number % 251 == 0, F.lit(-8_300_000_000_000_000_000)).when(
        number % 241 == 0, F.lit(8_300_000_000_000_000_000)
    )
    lat = F.when(number % 239 == 0, F.lit(1e30)).when(number % 233 == 0, F.lit(-1e-7))
    return (
        event_points(spark, sf_dir)
        .withColumn("epoch_ns", F.coalesce(time, F.col("epoch_ns")))
        .withColumn("lat", F.coalesce(lat.cast("float"), F.col("lat")))
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, file_day, line)``: every event as one text line, some of
    them dirty (no text, missing tokens, an unreadable altitude)."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "value",
        F.col("ts").cast("date").alias("file_day"),
        F.call_function("div", epoch_ns_of_timestamp(F.col("ts")), F.lit(1000)).alias("us"),
        _mask().alias("mask"),
    )
    chi = F.col("user_id") % 61
    altitude = F.round(F.col("value") * 100.0).cast("bigint").cast("string")
    full = F.concat(
        F.lit(" "),
        F.expr("(us div 1000000) % 86400").cast("string"),
        F.lit("."),
        F.lpad(F.expr("us % 1000000").cast("string"), 6, "0"),
        F.lit("  33."),
        F.lpad((F.col("event_id") % 997).cast("string"), 3, "0"),
        F.lit(" -101."),
        F.lpad((F.col("event_id") * 7 % 1009).cast("string"), 4, "0"),
        F.lit(" "),
        F.when(F.col("event_id") % 97 == 0, "bad").otherwise(altitude),
        F.lit(" "),
        F.floor(chi / 10).cast("string"),
        F.lit("."),
        (chi % 10).cast("string"),
        F.lit(" "),
        (F.col("event_id") % 141 - 70).cast("string"),
        F.lit(" 0x"),
        F.lower(F.hex("mask")),
    )
    line = (
        F.when(F.col("event_id") % 103 == 0, "")
        .when(F.col("event_id") % 101 == 0, "  12.5 33.5")
        .otherwise(full)
    )
    return rows.select("event_id", "file_day", line.alias("line"))


def event_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, path)``: a file name per event, one in five of a shape that
    is not an input file, one in seven with an impossible date."""
    rows = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 7 == 0, "249917").otherwise(F.date_format("ts", "yyMMdd"))
    number = F.col("event_id").cast("string")
    stem = F.concat(F.lit("data/LYLOUT_"), day, F.lit("_"), number)
    path = (
        F.when(F.col("event_id") % 10 == 3, F.concat(stem, F.lit("_0600.txt")))
        .when(F.col("event_id") % 10 == 8, F.concat(stem, F.lit(".dat")))
        .when(F.col("event_id") % 2 == 1, F.concat(stem, F.lit("_0600.dat.gz")))
        .otherwise(F.concat(stem, F.lit("_0600.dat")))
    )
    return rows.select("event_id", path.alias("path"))


EMPTY_FILE = "LYLOUT_990101_000000_86400.dat"
_files: dict[tuple[str, str], str] = {}


def _event_folder(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        folder = scratch_folder(spark)
        lines = event_lines(spark, sf_dir).select("file_day", "line")
        odd = F.dayofmonth("file_day") % 2 == 1
        write_dat_lines(lines.where(~odd), f"{folder}/2024/plain")
        write_dat_lines(lines.where(odd), f"{folder}/2024/gz ip", gzip=True)
        # A file of another name, and one that is a header and nothing else.
        note = spark.range(1).select(F.lit("not a point file").alias("value"))
        note.coalesce(1).write.text(f"{folder}/2024/plain/notes")
        empty = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/2024/gz ip/{EMPTY_FILE}")
        fs = empty.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        file = fs.create(empty)
        file.writeBytes("header line\n" * HEADER_LINES)
        file.close()
        _files[key] = folder
    return _files[key]


def event_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Folders of text files holding `event_lines`, written once per
    application: even days plain, odd days gzipped, below a name with a blank."""
    folder = _event_folder(spark, sf_dir)
    return [f"{folder}/2024/plain", f"{folder}/2024/gz ip"]


def event_root(spark: SparkSession, sf_dir: str) -> str:
    """The folder above all of them."""
    return _event_folder(spark, sf_dir)


STRIKE_SCHEMA = "event_id bigint, us bigint, lat double, lon double, current float"


def strike_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of delimited text with a record of every event, some with a
    latitude that is no number, some too short, and a line of comment; written
    once per application."""
    key = (spark.sparkContext.applicationId, f"strikes {sf_dir}")
    if key not in _files:
        number = F.col("event_id")
        head = [number.cast("string"), F.call_function("div", epoch_ns_of_timestamp(F.col("ts")), F.lit(1000)).cast("string")]
        lat = F.concat(F.when(number % 97 == 0, "x").otherwise("33."), F.lpad((number % 997).cast("string"), 3, "0"))
        lon = F.concat(F.lit("-101."), F.lpad((number * 7 % 1009).cast("string"), 4, "0"))
        rest = [lat, lon, (number % 141 - 70).cast("string")]
        short = F.concat_ws(";", *head)
        line = F.when(number % 101 == 0, short).otherwise(F.concat_ws(";", short, *rest))
        folder = scratch_folder(spark)
        table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
        spark.range(1).select(F.lit("# a comment").alias("value")).write.mode("append").text(folder)
        _files[key] = folder
    return _files[key]


_stores: dict[tuple[str, str], PointStore] = {}


def event_store(spark: SparkSession, sf_dir: str) -> PointStore:
    """A versioned table of `event_files`, loaded once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = PointStore(spark, scratch_folder(spark))
        store.replace(event_files(spark, sf_dir))
        _stores[key] = store
    return _stores[key]
