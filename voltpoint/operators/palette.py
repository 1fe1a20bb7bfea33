"""Normalised value -> colour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[float, float, float]


def _channel(position: Column, entries: Sequence[float]) -> Column:
    table = F.array(*[F.lit(float(e)) for e in entries])
    last = F.lit(len(entries) - 1)
    base = F.floor(position)

    def entry(index: Column) -> Column:
        return F.get(table, F.greatest(F.lit(0), F.least(last, index.cast("int"))))

    low, high = entry(base), entry(base + 1)
    return low + (high - low) * (position - base)


def apply_palette(df: DataFrame, palette: Sequence[RGB], column: str = "color") -> DataFrame:
    """Adds ``red``, ``green``, ``blue`` in 0..1.

    Entries sit at the centres of equal parts of 0..1; values between two
    centres are interpolated and values beyond the outer centres take the end
    colour. The palette is a constant of the plan."""
    position = F.col(column).cast("double") * len(palette) - 0.5
    return df.select(
        "*",
        *[
            _channel(position, [entry[i] for entry in palette]).alias(channel)
            for i, channel in enumerate(("red", "green", "blue"))
        ],
    )
