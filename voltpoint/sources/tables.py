"""Lifecycle of the point table: replace, keep, stage, clear."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint.sources.export import write_parquet

POINT_VIEW, STRIKE_VIEW = "lma", "ctg"


def replace_load(points: DataFrame, view: str = POINT_VIEW) -> DataFrame:
    """Make ``points`` the content of ``view``; an earlier load is dropped."""
    points.createOrReplaceTempView(view)
    return points.sparkSession.table(view)


def keep(points: DataFrame) -> DataFrame:
    """Keep the points across re-filters; what does not fit memory goes to disk.

    For more data than the cluster can cache use `stage`."""
    return points.persist(StorageLevel.MEMORY_AND_DISK)


def stage(points: DataFrame, path: str, **options) -> DataFrame:
    """Write the points as day-partitioned Parquet and read them back, so that
    later filters are pushed into a columnar scan instead of parsing text."""
    write_parquet(points, path, **options)
    return read_staged(points.sparkSession, path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Bits of each column in the order of a clustered table, and bytes of its row groups.
ORDER_BITS, GROUP_BYTES = 15, 8 << 20


def _spread(value: Column, by: int) -> Column:
    """The bits of a number, ``by`` places apart."""
    found = F.lit(0).cast("bigint")
    for bit in range(ORDER_BITS):
        found = found.bitwiseOR(F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), bit * by))
    return found


def curve(points: DataFrame, columns: list[str]) -> DataFrame:
    """``points`` with ``_curve``: their place on a space-filling curve through up
    to four columns, each cut into 2**15 equal parts of its range; NULL is first."""
    from voltpoint.operators.extents import EXTENT, attach_extent, extent, finite
    from voltpoint.operators.raster import cell

    fields = [f"{c}_{side}" for c in columns for side in ("min", "max")]
    attached = attach_extent(points, extent(points, columns), fields)
    parts = [
        F.coalesce(cell(finite(points, c), F.col(f"{EXTENT}.{c}_min"), F.col(f"{EXTENT}.{c}_max"), 1 << ORDER_BITS), F.lit(0))
        for c in columns
    ]
    place = F.lit(0).cast("bigint")
    for i, part in enumerate(parts):
        place = place.bitwiseOR(F.shiftleft(_spread(part, len(columns)), i))
    return attached.select(*points.columns, place.alias("_curve"))


def cluster(
    points: DataFrame, path: str, columns: tuple[str, ...] = ("epoch_ns", "lon", "lat", "alt"), *, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Write the points in the order of a space-filling curve and read them back.

    Points near each other in all of ``columns`` share row groups, whose minima
    and maxima let a filter on any of the columns skip the others. One range
    shuffle; ranges come from a sample of the curve, so no task has a hot key but
    for points that are equal in all columns."""
    placed = curve(points, list(columns))
    ordered = placed.repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve")
    ordered.write.mode("error").option("parquet.block.size", str(group_bytes)).parquet(path)
    return points.sparkSession.read.parquet(path)


def clear(spark: SparkSession, *kept: DataFrame, view: str = POINT_VIEW, strikes: str = STRIKE_VIEW) -> None:
    """Drop the views of points and strikes and release kept frames; clearing
    nothing is no error."""
    for name in (view, strikes):
        spark.catalog.dropTempView(name)
    for frame in kept:
        frame.unpersist()
