"""Display helpers: text, colours and raster positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions and colours (red, green, blue) of the ramp, and the colour of missing data.
RAMP = (
    (0.0, 48, 18, 59),
    (0.2, 50, 84, 179),
    (0.4, 31, 174, 174),
    (0.6, 150, 214, 75),
    (0.8, 249, 154, 28),
    (1.0, 180, 4, 38),
)
NO_DATA_COLOUR = (230, 230, 230)
NO_DATA_TEXT = "NoData"


def is_no_data(value: Column) -> Column:
    """Null, NaN and infinite values have no colour."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def unit_range(value: Column, low: Column, high: Column) -> Column:
    """The place of a value between low and high, from 0 to 1."""
    return F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))


def ramp_colour(place: Column) -> Column:
    """A struct (r, g, b) of ints: piecewise linear between the stops, halves to even."""
    out = []
    for channel in (1, 2, 3):
        colour = F.lit(RAMP[-1][channel])
        for left, right in reversed(list(zip(RAMP, RAMP[1:]))):
            part = (place - left[0]) / (right[0] - left[0])
            colour = F.when(place <= right[0], F.bround(F.lit(float(left[channel])) + float(right[channel] - left[channel]) * part).cast("int")).otherwise(colour)
        out.append(colour.cast("int"))
    return F.struct(*(c.alias(n) for c, n in zip(out, "rgb")))


def value_colour(value: Column, low: Column, high: Column) -> Column:
    """The ramp's colour of a value, grey for missing ones."""
    lowest = F.coalesce(low, F.lit(0.0))
    ramp = ramp_colour(unit_range(value, lowest, F.coalesce(high, lowest)))
    grey = F.struct(*(F.lit(v).alias(n) for v, n in zip(NO_DATA_COLOUR, "rgb")))
    return F.when(is_no_data(value), grey).otherwise(ramp)


def format_value(value: Column) -> Column:
    """Up to five decimals, or the text for missing values."""
    return F.coalesce(F.call_function("format_number", value, F.lit("0.#####")), F.lit(NO_DATA_TEXT))


def format_any(value: Column) -> Column:
    """Floating-point numbers with up to five decimals, True or False, and else the plain text."""
    text, kind = value.cast("string"), F.typeof(value)
    number = F.call_function("format_number", text.try_cast("double"), F.lit("0.#####"))
    return F.coalesce(F.when(kind.isin("double", "float"), number).when(kind == "boolean", F.initcap(text)).otherwise(text), F.lit(NO_DATA_TEXT))


def depth_label(depth: Column) -> Column:
    return F.concat(F.call_function("format_number", depth, F.lit("0.###")), F.lit(" m"))


def parse_double(text: Column) -> Column:
    """Null where the text, white space around it aside, is no decimal number, infinity or NaN."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:infinity|nan)))\s*$", 1).try_cast("double")


def parse_int(text: Column) -> Column:
    """Null where the text, white space around it aside, is no whole number of 32 bits."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1).try_cast("int")


def raster_cell(x: Column, y: Column, shown_width: float, shown_height: float, width: int, height: int) -> Column:
    """The raster's (row, column) under a point of the shown image."""

    def place(at: Column, shown: float, n: int) -> Column:
        part = F.least(F.greatest(at / F.lit(float(shown)), F.lit(0.0)), F.lit(0.999999))
        return F.least(F.greatest(F.floor(part * F.lit(n)).cast("int"), F.lit(0)), F.lit(n - 1))

    return F.struct(place(y, shown_height, height).alias("row"), place(x, shown_width, width).alias("column"))
