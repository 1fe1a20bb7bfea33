"""Compare a Spark result with its SQL counterpart, value by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None:
        return (0, 0)
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value))
    return (2, str(value))


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(map(_key, row)) for row in zip(*columns)))


def kinds_of(table) -> dict[str, str]:
    return {n: str(table.schema.field(n).type).replace("large_", "") for n in sorted(table.column_names)}


def differences(spark_table, sql_table) -> list[str]:
    found = []
    if kinds_of(spark_table) != kinds_of(sql_table):
        found.append(f"schema: {kinds_of(spark_table)} != {kinds_of(sql_table)}")
    elif spark_table.num_rows != sql_table.num_rows:
        found.append(f"rows: {spark_table.num_rows} != {sql_table.num_rows}")
    else:
        for ours, theirs in zip(rows_of(spark_table), rows_of(sql_table)):
            if ours != theirs:
                found.append(f"value: {ours} != {theirs}")
                break
    return found
