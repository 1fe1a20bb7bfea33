"""Delimited text of records of another kind, such as cloud-to-ground strikes.

No layout of such files is fixed here: the caller gives names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REJECTED = "rejected"


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | str,
    *,
    delimiter: str = ",",
    header: bool = False,
    comment: str | None = None,
    rejected: str = REJECTED,
    **options: str,
) -> DataFrame:
    """The columns of ``schema``, and in ``rejected`` the whole record where a
    field cannot be read as its type or fields are missing or left over.

    A record with a bad field keeps its other fields; it is NULL in ``rejected``
    where all is well, so ``where(rejected IS NULL)`` are the clean records.
    Blank lines and lines that begin with ``comment`` are skipped. More options
    are those of Spark's reader (formats of dates, quotes and so on)."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if rejected in fields.fieldNames():
        raise ValueError(f"a column named {rejected!r} exists: name another for rejected records")
    reader = (
        spark.read.schema(T.StructType([*fields.fields, T.StructField(rejected, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", rejected)
        .option("sep", delimiter)
        .option("header", header)
        .option("enforceSchema", True)
        .options(**options)
    )
    if comment is not None:
        reader = reader.option("comment", comment)
    return reader.csv(paths)
