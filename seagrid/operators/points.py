"""Nearest-value lookup of points in a field.

Indexes are found per axis on the points, where axes are small and travel with the
plan; then points meet cells in one equi-join on month, depth, latitude and block of
longitudes, whose size the points and the touched cell rows decide. Catalyst may
broadcast either side by its measured size; a point table of any size shuffles by
the cell key instead, and a crowded cell row is split by adaptive skew handling.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.errors import GridDataError
from seagrid.functions.axes import axis_bounds, axis_value, nearest_index, normalize_longitude
from seagrid.functions.decode import unpack
from seagrid.functions.timefile import month_or_now, resolve_file
from seagrid.schema import LON_BLOCK
from seagrid.sources.field import Field


def valid_latitude(latitude: Column) -> Column:
    """From -90 to 90; NaN passes, as neither bound excludes it."""
    return F.isnan(latitude) | latitude.between(-90.0, 90.0)


def valid_longitude(longitude: Column) -> Column:
    """From -360 to 360; NaN passes."""
    return F.isnan(longitude) | longitude.between(-360.0, 360.0)


def checked_points(points: DataFrame) -> DataFrame:
    """The points, failing when run if a latitude or longitude is out of range or null."""
    wrong = lambda text, c: F.raise_error(F.concat(F.lit(text), c.cast("string"))).cast("double")
    return points.withColumns(
        {
            "latitude": F.when(F.coalesce(valid_latitude(F.col("latitude")), F.lit(False)), F.col("latitude")).otherwise(wrong("Latitude must be between -90 and 90 degrees: ", F.coalesce("latitude", F.lit(math.nan)))),
            "longitude": F.when(F.coalesce(valid_longitude(F.col("longitude")), F.lit(False)), F.col("longitude")).otherwise(wrong("Longitude must be between -360 and 360 degrees: ", F.coalesce("longitude", F.lit(math.nan)))),
        }
    )


def merged_metadata(field: Field, file: Column, sampling: Column) -> Column:
    """The source's metadata; the file and the sampling replace equal keys."""
    given = {k: v for k, v in (field.metadata or {}).items() if k not in ("file", "sampling")}
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs, F.lit("file"), file, F.lit("sampling"), sampling)


def point_indexes(points: DataFrame, field: Field, now: datetime) -> DataFrame:
    """The points with month, depth_i, lat_i and lon_i of their nearest cell."""
    layout = field.layout
    if not len(layout.lat) or not len(layout.lon) or (layout.depth is not None and not len(layout.depth)):
        raise GridDataError("Coordinate axis is empty.")
    low, high = axis_bounds(layout.lon)
    depth = F.lit(0) if layout.depth is None else nearest_index(F.coalesce(F.col("depth"), F.lit(float(layout.depth[0]))), layout.depth)
    return points.withColumns(
        {
            "month": month_or_now(F.col("date_time"), now),
            "lat_i": nearest_index(F.col("latitude"), layout.lat),
            "lon_i": nearest_index(normalize_longitude(F.col("longitude"), low, high), layout.lon),
            "depth_i": depth,
        }
    )


def cell_keys(field: Field, lat_i: Column, lon_i: Column, depth_i: Column, month: Column) -> dict[str, Column]:
    """Where in the field's cells a place is: axes that don't move the variable stand at 0."""
    uses = field.layout.uses
    lon = lon_i if "lon" in uses else F.lit(0)
    return {
        "k_month": month if field.monthly else F.lit(0),
        "k_depth": depth_i if "depth" in uses else F.lit(0),
        "k_lat": lat_i if "lat" in uses else F.lit(0),
        "k_block": F.floor(lon / LON_BLOCK).cast("int"),
        "k_at": (lon % LON_BLOCK).cast("int"),
    }


def read_cells(df: DataFrame, field: Field) -> DataFrame:
    """``df``, which has the columns of ``cell_keys``, with the decoded ``value``."""
    cells = field.cells
    on = (F.col("k_month") == cells["month"]) & (F.col("k_depth") == cells["depth_i"]) & (F.col("k_lat") == cells["lat_i"]) & (F.col("k_block") == cells["lon_block"])
    joined = df.join(cells, on, "left").withColumn("value", unpack(F.get(cells["values"], F.col("k_at")), field.layout.packing))
    return joined.drop(cells["month"], cells["depth_i"], cells["lat_i"], cells["lon_block"], cells["values"], "k_month", "k_depth", "k_lat", "k_block", "k_at")


def nearest_points(points: DataFrame, field: Field, *, now: datetime | None = None, check: bool = True) -> DataFrame:
    """One row per point: the nearest value (null if missing) and the place it stands at.

    ``points``: query_id, latitude, longitude, depth, date_time and sampling.
    """
    now = now or datetime.now()
    layout = field.layout
    found = point_indexes(checked_points(points) if check else points, field, now)
    p_month = F.col("p_month")
    found = found.withColumnsRenamed({"month": "p_month", "lat_i": "p_lat", "lon_i": "p_lon", "depth_i": "p_depth"})
    keyed = found.withColumns(cell_keys(field, F.col("p_lat"), F.col("p_lon"), F.col("p_depth"), p_month))
    file = F.lit(field.file).cast("string")
    if field.monthly and field.file_pattern:
        file = F.element_at(F.array(*(F.lit(resolve_file(field.file or "", field.file_pattern, m)) for m in range(1, 13))), p_month)
    return read_cells(keyed, field).select(
        "query_id",
        F.lit(field.source_id).alias("source_id"),
        F.lit(field.type).alias("type"),
        "value",
        F.lit(field.unit).cast("string").alias("unit"),
        axis_value(layout.lat, F.col("p_lat")).alias("latitude"),
        axis_value(layout.lon, F.col("p_lon")).alias("longitude"),
        (F.lit(None).cast("double") if layout.depth is None else axis_value(layout.depth, F.col("p_depth"))).alias("depth"),
        "date_time",
        F.lit(field.variable).alias("variable"),
        merged_metadata(field, file, F.col("sampling")).alias("metadata"),
    )


def nearest_in_all(points: DataFrame, fields: list[Field], *, now: datetime | None = None, check: bool = True) -> DataFrame:
    """The rows of every field in which the point has a value; fields of one kind all answer."""
    if not fields:
        raise ValueError("no field to query")
    return reduce(DataFrame.unionByName, [nearest_points(points, f, now=now, check=check) for f in fields]).filter(F.col("value").isNotNull())
