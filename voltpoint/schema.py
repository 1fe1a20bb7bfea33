"""Fixed schemas, thresholds and panel bindings of the point data model."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import types as T

# --- fixed values: the input file format -----------------------------------
HEADER_LINES = 53
# To be found at the end of a path; the first number is the day, yymmdd.
FILE_NAME_PATTERN = r"\w_(\d+)_\d+_\d+\.dat(\.gz)?$"
# A superset of the pattern above that file listing can apply by itself.
FILE_NAME_GLOB = "*_[0-9]*_[0-9]*_[0-9]*.{dat,dat.gz}"

NANOS_PER_SECOND = 1_000_000_000
SECONDS_PER_DAY = 86_400

LINE_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_day", T.DateType()),
        T.StructField("line", T.StringType()),
    ]
)

# Spark has no nanosecond timestamp, so epoch_ns BIGINT is the canonical time.
POINT_SCHEMA = T.StructType(
    [
        T.StructField("epoch_ns", T.LongType()),
        T.StructField("lat", T.FloatType()),
        T.StructField("lon", T.FloatType()),
        T.StructField("alt", T.FloatType()),
        T.StructField("chi", T.FloatType()),
        T.StructField("pdb", T.FloatType()),
        T.StructField("number_stations", T.ByteType()),
    ]
)
POINT_COLUMNS = POINT_SCHEMA.fieldNames()


# --- fixed values: the default selection ------------------------------------
@dataclass(frozen=True)
class Thresholds:
    """The seven selection thresholds; every bound is inclusive."""

    min_stations: float = 6.0
    min_alt: float = 0.0
    max_alt: float = 20.0
    min_chi: float = 0.0
    max_chi: float = 5.0
    min_power: float = -60.0
    max_power: float = 60.0

    def __post_init__(self) -> None:
        # A threshold is a single-precision number that reaches the comparison
        # as a literal with six decimals.
        for f in fields(self):
            value = float(np.float32(getattr(self, f.name)))
            object.__setattr__(self, f.name, float(f"{value:.6f}"))

    def bounds(self) -> dict[str, tuple[float | None, float | None]]:
        """Column -> (low, high), None where a side is open."""
        return {
            "number_stations": (self.min_stations, None),
            "alt": (self.min_alt, self.max_alt),
            "chi": (self.min_chi, self.max_chi),
            "pdb": (self.min_power, self.max_power),
        }


# --- fixed values: panels and ticks -----------------------------------------
# Panel -> (x axis, y axis).
PANELS = {
    "time_alt": ("time", "alt"),
    "lon_alt": ("lon", "alt"),
    "lon_lat": ("lon", "lat"),
    "alt_lat": ("alt", "lat"),
}
# The altitude histogram has a y axis only: its x axis is a count.
EXTENT_PANELS = {**PANELS, "alt_hist": (None, "alt")}

# Altitude axes carry three labels, all other axes five:
# label i sits at first + i * step of the axis.
TICK_FIRST = 0.1
TICKS_5 = {"count": 5, "step": 0.2}
TICKS_3 = {"count": 3, "step": 0.4}
