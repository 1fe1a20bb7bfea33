"""Hand-made point frames."""

from __future__ import annotations

from voltpoint.schema import POINT_COLUMNS, POINT_SCHEMA

DEFAULTS = {
    "epoch_ns": 1_700_000_000_000_000_000,
    "lat": 33.5,
    "lon": -101.5,
    "alt": 8.0,
    "chi": 1.0,
    "pdb": 10.0,
    "number_stations": 8,
}


def frame(spark, rows: list[dict]):
    data = [tuple({**DEFAULTS, **row}[c] for c in POINT_COLUMNS) for row in rows]
    return spark.createDataFrame(data, POINT_SCHEMA)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
