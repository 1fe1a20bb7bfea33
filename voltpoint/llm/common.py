"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpoint.sources.scratch import remove_folder, scratch_folder

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}
#: Tables written while a `settled` result is being made, innermost last.
_on_the_way: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = scratch_folder(spark)
    return _folders[app]


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` below the scratch folder and read it back: cuts the
    lineage and outlives lost executors."""
    path = f"{scratch(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for tables in _on_the_way:
        tables.append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, written by `staged`; the tables that were staged on the way to
    it are removed then, as only the result is read from there on."""
    tables: list[str] = []
    _on_the_way.append(tables)
    try:
        frame = make()
    finally:
        _on_the_way.pop()
    result = staged(frame, name)
    for path in tables:
        remove_folder(frame.sparkSession, path)
    return result


def numbered(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` with a number ``rid`` of each, written once: a second scan of the
    input may be cut into other partitions and number its rows otherwise."""
    return staged(rows.withColumn("rid", F.monotonically_increasing_id()), name)


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, whatever else the table holds."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def binary_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
