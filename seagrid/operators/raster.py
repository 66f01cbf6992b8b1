"""Regular rasters sampled from a field.

Rows run from north to south and columns from west to east. The positions of rows
and columns are found once each, so that only H + W searches are made; every row
then takes its values out of the cell rows of its latitude.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.errors import GridDataError
from seagrid.functions.axes import axis_bounds, axis_literal, bisect_nearest
from seagrid.functions.decode import unpack
from seagrid.functions.timefile import resolve_file
from seagrid.schema import LON_BLOCK
from seagrid.sources.field import Field

LEAST_SIDE, MOST_SIDE = 2, 2048


@dataclass(frozen=True)
class GridSpec:
    min_latitude: float
    max_latitude: float
    min_longitude: float
    max_longitude: float
    depth: float | None = None
    date_time: datetime | None = None
    width: int = 480
    height: int = 300
    sampling: str = "Nearest"


def check_bounds(spec: GridSpec) -> None:
    if any(v < -90 or v > 90 for v in (spec.min_latitude, spec.max_latitude)):
        raise ValueError("Latitude bounds must be between -90 and 90 degrees.")
    if any(v < -360 or v > 360 for v in (spec.min_longitude, spec.max_longitude)):
        raise ValueError("Longitude bounds must be between -360 and 360 degrees.")
    if spec.min_latitude >= spec.max_latitude or spec.min_longitude >= spec.max_longitude:
        raise ValueError("Minimum bounds must be less than maximum bounds.")


def check_size(spec: GridSpec) -> None:
    if not all(LEAST_SIDE <= n <= MOST_SIDE for n in (spec.width, spec.height)):
        raise ValueError(f"Grid width and height must be between {LEAST_SIDE} and {MOST_SIDE}.")


def shifted_longitudes(longitude: np.ndarray, low: float, high: float) -> np.ndarray:
    if low >= 0 and high > 180:
        return np.where(longitude < 0, longitude + 360, longitude)
    if low < 0 and high <= 180:
        return np.where(longitude > 180, longitude - 360, longitude)
    return longitude


@dataclass(frozen=True)
class Sampling:
    """Positions of a raster's rows and columns on the axes; at most 2,048 each."""

    lat_i: np.ndarray
    lon_i: np.ndarray
    depth_i: int
    month: int


def sample_positions(field: Field, spec: GridSpec, now: datetime) -> Sampling:
    layout = field.layout
    if not len(layout.lat) or not len(layout.lon) or (layout.depth is not None and not len(layout.depth)):
        raise GridDataError("Coordinate axis is empty.")
    rows = spec.max_latitude + (spec.min_latitude - spec.max_latitude) * (np.arange(spec.height) / (spec.height - 1))
    columns = spec.min_longitude + (spec.max_longitude - spec.min_longitude) * (np.arange(spec.width) / (spec.width - 1))
    depth_i = 0
    if layout.depth is not None:
        depth_i = int(bisect_nearest(layout.depth, np.array([layout.depth[0] if spec.depth is None else spec.depth], np.float64))[0])
    lon = bisect_nearest(layout.lon, shifted_longitudes(columns, *axis_bounds(layout.lon)))
    return Sampling(bisect_nearest(layout.lat, rows), lon, depth_i, (spec.date_time or now).month)


def raster_lines(field: Field, spec: GridSpec, *, now: datetime | None = None) -> DataFrame:
    """One row per raster row: row, latitude and values, an array in column order."""
    check_bounds(spec)
    check_size(spec)
    at = sample_positions(field, spec, now or datetime.now())
    spark, layout, uses = field.cells.sparkSession, field.layout, field.layout.uses
    lat_i, lon_i = (at.lat_i if "lat" in uses else np.zeros_like(at.lat_i)), (at.lon_i if "lon" in uses else np.zeros_like(at.lon_i))
    ints = lambda v: F.split(F.lit(",".join(map(str, v.tolist()))), ",").cast("array<int>")
    rows = spark.range(spec.height).select(F.col("id").cast("int").alias("row"), F.get(ints(lat_i), F.col("id").cast("int")).alias("k_lat"), F.get(axis_literal(layout.lat[at.lat_i]), F.col("id").cast("int")).alias("latitude"))
    blocks = np.unique(lon_i // LON_BLOCK).tolist()
    cells = field.cells.filter(
        (F.col("month") == (at.month if field.monthly else 0))
        & (F.col("depth_i") == (at.depth_i if "depth" in uses else 0))
        & F.col("lat_i").between(int(lat_i.min()), int(lat_i.max()))
        & F.col("lon_block").isin(blocks)
    )
    # At most 2,048 rows ask, so their side is the small one whatever the field's size.
    wide = F.broadcast(rows.select("k_lat").distinct()).join(cells, F.col("k_lat") == F.col("lat_i")).groupBy("k_lat").agg(F.map_from_entries(F.collect_list(F.struct("lon_block", "values"))).alias("parts"))
    columns = ints(lon_i)

    def read(c: Column) -> Column:
        raw = F.get(F.element_at("parts", F.floor(c / LON_BLOCK).cast("int")), (c % LON_BLOCK).cast("int"))
        return unpack(raw, layout.packing)

    return rows.join(wide, "k_lat", "left").select("row", "latitude", F.when(F.col("parts").isNull(), F.array_repeat(F.lit(None).cast("double"), spec.width)).otherwise(F.transform(columns, read)).alias("values"))


def raster_cells(field: Field, spec: GridSpec, *, now: datetime | None = None) -> DataFrame:
    """One row per raster cell: source_id, row, col, latitude, longitude, value (null if missing)."""
    check_bounds(spec)
    check_size(spec)
    at = sample_positions(field, spec, now or datetime.now())
    lines = raster_lines(field, spec, now=now)
    cells = lines.select("row", "latitude", F.posexplode("values").alias("col", "value"))
    longitude = F.get(axis_literal(field.layout.lon[at.lon_i]), F.col("col"))
    return cells.select(F.lit(field.source_id).alias("source_id"), "row", "col", "latitude", longitude.alias("longitude"), "value")


def nan_min(value: Column) -> Column:
    """The least value; NaN if any is NaN, null if all are null."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(F.min(value))


def raster_summary(field: Field, spec: GridSpec, *, now: datetime | None = None) -> DataFrame:
    """One row about the raster: size, bounds, depth, minimum, maximum and metadata.

    The metadata names the file that was read; the bounds asked for stand in a column of
    their own instead of the entry ``requestedBounds``.
    """
    now = now or datetime.now()
    at = sample_positions(field, spec, now)
    cells = raster_cells(field, spec, now=now)
    layout = field.layout
    file = resolve_file(field.file or "", field.file_pattern, at.month) if field.monthly else field.file
    given = {k: v for k, v in (field.metadata or {}).items() if k not in ("file", "sampling", "requestedBounds")} | {"file": file, "sampling": spec.sampling}
    pairs = [F.lit(x).cast("string") for k, v in given.items() for x in (k, v)]
    return cells.agg(nan_min(F.col("value")).alias("minimum"), F.max("value").alias("maximum")).select(
        F.lit(field.source_id).alias("source_id"),
        F.lit(field.type).alias("type"),
        F.lit(spec.width).alias("width"),
        F.lit(spec.height).alias("height"),
        F.lit(field.unit).cast("string").alias("unit"),
        F.lit(None if layout.depth is None else float(layout.depth[at.depth_i])).cast("double").alias("depth"),
        F.lit(spec.date_time).cast("timestamp_ntz").alias("date_time"),
        F.lit(field.variable).alias("variable"),
        "minimum",
        "maximum",
        F.create_map(*pairs).alias("metadata"),
        F.array(*(F.lit(float(v)) for v in (spec.min_latitude, spec.max_latitude, spec.min_longitude, spec.max_longitude))).alias("requested_bounds"),
    )


def raster_result(field: Field, spec: GridSpec, *, now: datetime | None = None) -> DataFrame:
    """The summary's row with latitudes, longitudes and all values, row by row from the north.

    A raster has 2,048 by 2,048 values at most, so the row is bounded.
    """
    now = now or datetime.now()
    at = sample_positions(field, spec, now)
    lines = raster_lines(field, spec, now=now).agg(F.sort_array(F.collect_list(F.struct("row", "latitude", "values"))).alias("lines"))
    arrays = lines.select(F.col("lines.latitude").alias("latitudes"), axis_literal(field.layout.lon[at.lon_i]).alias("longitudes"), F.flatten("lines.values").alias("values"))
    return raster_summary(field, spec, now=now).crossJoin(F.broadcast(arrays))  # one row each


def cell_value(cells: DataFrame, spec: GridSpec, row: int, column: int) -> DataFrame:
    """The value of one raster cell; positions are checked."""
    if not 0 <= row < spec.height or not 0 <= column < spec.width:
        raise IndexError(f"no cell ({row}, {column}) in a raster of {spec.height} x {spec.width}")
    return cells.filter((F.col("row") == row) & (F.col("col") == column)).select("value")
