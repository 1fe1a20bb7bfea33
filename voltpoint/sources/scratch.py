"""Folders for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder the cluster names in
    ``spark.checkpoint.dir``.

    Only a local master, whose tasks all run on this machine, may do without:
    it gets a temporary folder. What is written there goes with `remove_scratch`,
    or when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/voltpoint-{uuid.uuid4().hex}"
    if spark.sparkContext._jsc is not None:
        path, fs = _file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    _made.append((spark, folder))
    return f"{folder}/work"


def written(frame: DataFrame) -> DataFrame:
    """``frame`` written to a scratch folder and read back: cuts the lineage and
    outlives lost executors."""
    path = scratch_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that nothing reads any more."""
    path, fs = _file_system(spark, folder)
    fs.delete(path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Remove what was written below the session's scratch folders."""
    for folder in [folder for session, folder in _made if session is spark]:
        remove_folder(spark, folder)
    _made[:] = [made for made in _made if made[0] is not spark]
