"""Packed values: fill tests, scale and offset."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    """Attributes of a packed variable; None where absent."""

    fill: float | None = None
    missing: float | None = None
    scale: float | None = None
    offset: float | None = None


def nearly_equal(value: Column, mark: float) -> Column:
    """Equal, or apart by no more than a millionth of a millionth of the mark (and NaN equals NaN)."""
    if math.isnan(mark):
        return F.isnan(value)
    if math.isinf(mark):
        # The allowance is infinite, so every finite value and the mark itself are within it.
        return ~F.isnan(value) & ((value == F.lit(mark)) | (F.abs(value - F.lit(mark)) <= F.lit(math.inf)))
    return ~F.isnan(value) & (F.abs(value - F.lit(mark)) <= F.lit(max(1e-12, abs(mark) * 1e-12)))


def unpack(raw: Column, packing: Packing) -> Column:
    """The decoded value; null where the raw value is a fill or missing mark."""
    value = raw
    if packing.scale is not None:
        value = value * F.lit(packing.scale)
    if packing.offset is not None:
        value = value + F.lit(packing.offset)
    marks = [nearly_equal(raw, m) for m in (packing.fill, packing.missing) if m is not None]
    for mark in marks:
        value = F.when(~mark, value)
    return value
