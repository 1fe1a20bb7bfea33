"""A versioned point table on disk: loads that are there as a whole or not at all.

Each load writes its points, a ledger of its files and the extents of its days
into folders of its own, and then one manifest, a small file that names the
loads the table consists of. Creating the manifest is the only step that changes
what readers see; a load that dies before leaves the earlier table. Manifests
are numbered and never overwritten, so of two loads at a time one fails.

The ledger is worked out from the written Parquet, not from the text again.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltpoint.schema import LINE_SCHEMA, POINT_COLUMNS, POINT_SCHEMA
from voltpoint.sources.export import write_parquet
from voltpoint.sources.lylout import Paths, list_files, load_report, read_points

#: Columns whose bounds are kept for each day.
BOUNDED = ("epoch_ns", "lon", "lat", "alt")
#: What a load writes; a load without a point has no file to tell it.
STORED = T.StructType([LINE_SCHEMA["file_path"], *POINT_SCHEMA.fields, LINE_SCHEMA["file_day"]])


def _finite(name: str):
    value = F.col(name)
    return value if name == "epoch_ns" else F.when(F.abs(value) < F.lit(float("inf")), value + F.lit(0.0).cast("float"))


def _as_path(uri: str) -> str:
    """A listed file's address as a path to read: not encoded, nothing a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


class PointStore:
    """The table below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # --- manifests ---------------------------------------------------------------

    def _manifest(self, number: int):
        return self._hadoop.Path(self._path, f"manifests/{number:012d}.json")

    def version(self) -> int:
        """The number of the newest manifest, 0 of a table that is not there."""
        folder = self._hadoop.Path(self._path, "manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def loads(self, version: int | None = None) -> list[str]:
        """The loads that a version consists of."""
        number = self.version() if version is None else version
        if number == 0:
            return []
        text = self.spark.read.text(self._manifest(number).toString(), wholetext=True).first()[0]
        return json.loads(text)["loads"]

    def _publish(self, loads: list[str], after: int) -> int:
        # Written aside first: the name appears with its content, and only once.
        aside = self._hadoop.Path(self._path, f"aside-{uuid.uuid4().hex}")
        file = self._fs.create(aside, False)
        file.writeBytes(json.dumps({"loads": loads}))
        file.close()
        target = self._manifest(after + 1)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {after + 1} was published by another load")
        return after + 1

    # --- loading -----------------------------------------------------------------

    def _write(self, points: DataFrame, files: DataFrame) -> str:
        load = uuid.uuid4().hex
        write_parquet(points, f"{self.root}/points/{load}", mode="error")
        points = self._read("points", [load])
        load_report(points, files).write.parquet(f"{self.root}/files/{load}")
        bounds = [f(_finite(c)).alias(f"{c}_{n}") for c in BOUNDED for n, f in (("min", F.min), ("max", F.max))]
        points.groupBy("file_day").agg(F.count("*").alias("rows"), *bounds).write.parquet(f"{self.root}/extents/{load}")
        return load

    def _load(self, paths: Paths, earlier: list[str], version: int, options: dict) -> int:
        files = list_files(self.spark, paths)
        if earlier:
            known = self._read("files", earlier).select("file_path", "file_size")
            files = files.join(known, ["file_path", "file_size"], "left_anti")
        # As many names as the listing on the driver holds already.
        new = [_as_path(r.file_path) for r in files.where("matched").select("file_path").collect()]
        if earlier and not new:
            return version
        points = read_points(self.spark, new, **options) if new else read_points(self.spark, paths, **options).where("false")
        return self._publish([*earlier, self._write(points, files)], version)

    def replace(self, paths: Paths, **options) -> int:
        """Make the points of these files the table; returns the new version."""
        return self._load(paths, [], self.version(), options)

    def append(self, paths: Paths, **options) -> int:
        """Add the points of those of these files that no load of the table has
        read yet, told by path and size; a repeated load adds nothing."""
        version = self.version()
        return self._load(paths, self.loads(version), version, options)

    # --- reading -----------------------------------------------------------------

    def _read(self, kind: str, loads: list[str]) -> DataFrame:
        reader = self.spark.read.schema(STORED) if kind == "points" else self.spark.read
        first, *rest = [reader.parquet(f"{self.root}/{kind}/{load}") for load in loads]
        for frame in rest:
            first = first.unionByName(frame)
        return first

    def points(self, version: int | None = None) -> DataFrame:
        """``file_day``, ``file_path`` and the point columns of a version."""
        loads = self.loads(version)
        if not loads:
            raise LookupError(f"no version {version or ''} below {self.root}")
        return self._read("points", loads).select("file_path", "file_day", *POINT_COLUMNS)

    def report(self) -> DataFrame:
        """Rows and unreadable values of every file, as counted when loaded."""
        return self._read("files", self.loads())

    def day_extents(self) -> DataFrame:
        return self._read("extents", self.loads())

    def extent(self, days: tuple[str, str] | None = None) -> DataFrame:
        """The row of `voltpoint.operators.point_extent` over all points, or those
        of the days from one to another, from the days' extents alone."""
        from voltpoint.functions.parse import exact_difference

        rows = self.day_extents()
        if days is not None:
            rows = rows.where(F.col("file_day").between(*[F.lit(d).cast("date") for d in days]))
        merged = rows.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("source_count"),
            *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in BOUNDED for n, f in (("min", F.min), ("max", F.max))],
        )
        low, high = F.col("epoch_ns_min"), F.col("epoch_ns_max")
        sides = [f"{c}_{n}" for c in BOUNDED[1:] for n in ("min", "max")]
        return merged.select("source_count", low.alias("t_min_ns"), high.alias("t_max_ns"), exact_difference(high, low).alias("span_ns"), *sides)
