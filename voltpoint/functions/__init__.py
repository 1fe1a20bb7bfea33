"""Column functions: text line to typed value, and file name to day."""

from voltpoint.functions.parse import (
    alt_km,
    difference,
    epoch_ns,
    epoch_ns_of_timestamp,
    file_day,
    file_name_matches,
    fixed_decimals,
    floor_div,
    parse_lines,
    split_spaces,
    station_count,
    timestamp_of_epoch_ns,
    to_double,
    to_float,
    to_int,
    token,
)

__all__ = [
    "alt_km",
    "difference",
    "epoch_ns",
    "epoch_ns_of_timestamp",
    "file_day",
    "file_name_matches",
    "fixed_decimals",
    "floor_div",
    "parse_lines",
    "split_spaces",
    "station_count",
    "timestamp_of_epoch_ns",
    "to_double",
    "to_float",
    "to_int",
    "token",
]
