"""Fields derived from the driver's tables, which hold no coordinates of their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.functions.decode import Packing
from seagrid.sources.field import Field, Layout

FILL = -32768.0
LATS, LONS = 25, 36
DEPTHS = (0.0, 10.0, 50.0, 100.0, 500.0)
PACKING = Packing(fill=FILL, scale=0.01, offset=5.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitudes() -> np.ndarray:
    return -60.0 + 5.0 * np.arange(LATS)


def longitudes() -> np.ndarray:
    return 10.0 * np.arange(LONS)


def packed_cells(rows: DataFrame, month: Column, depth_i: Column, lat_i: Column, lon_i: Column, amount: Column, limit: float) -> DataFrame:
    """CELLS whose raw value is the hundredth part of a group's least amount, or the fill mark above ``limit``."""
    least = rows.groupBy(month.cast("int").alias("month"), depth_i.cast("int").alias("depth_i"), lat_i.cast("int").alias("lat_i"), lon_i.cast("int").alias("lon_i")).agg(F.min(amount).alias("least"))
    raw = F.when(F.col("least") > limit, F.lit(FILL)).otherwise(F.floor(F.col("least") / 100).cast("double"))
    lines = least.withColumn("raw", raw).groupBy("month", "depth_i", "lat_i").agg(F.map_from_entries(F.collect_list(F.struct("lon_i", "raw"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(LONS - 1))
    return lines.select("month", "depth_i", "lat_i", F.lit(0).alias("lon_block"), F.transform(places, lambda i: F.try_element_at(F.col("m"), i)).alias("values"))


def price_field(spark: SparkSession, sf_dir: str) -> Field:
    """Least order price by customer and order number."""
    orders = table(spark, sf_dir, "orders")
    cells = packed_cells(orders, F.lit(0), F.lit(0), F.col("o_custkey") % LATS, F.col("o_orderkey") % LONS, F.col("o_totalprice"), 60000.0)
    return Field("PRICE", "Bathymetry", "price", Layout(latitudes(), longitudes(), None, PACKING, ("lat", "lon")), cells, "m", {"dataset": "orders", "sampling": "replaced"}, file="orders.parquet")


def quantity_field(spark: SparkSession, sf_dir: str) -> Field:
    """Least line price by part and order."""
    lines = table(spark, sf_dir, "lineitem")
    cells = packed_cells(lines, F.lit(0), F.lit(0), F.col("l_partkey") % LATS, F.col("l_orderkey") % LONS, F.col("l_extendedprice"), 2000.0)
    return Field("QUANTITY", "Bathymetry", "quantity", Layout(latitudes(), longitudes(), None, PACKING, ("lat", "lon")), cells, "m", None, file="lineitem.parquet")


def depth_field(spark: SparkSession, sf_dir: str) -> Field:
    orders = table(spark, sf_dir, "orders")
    cells = packed_cells(orders, F.lit(0), F.col("o_orderkey") % 5, F.col("o_custkey") % LATS, F.floor(F.col("o_orderkey") / 5) % LONS, F.col("o_totalprice"), 90000.0)
    return Field("DEPTH", "Temperature", "t_an", Layout(latitudes(), longitudes(), np.array(DEPTHS), PACKING), cells, "degC", None, file="orders.parquet")


def monthly_field(spark: SparkSession, sf_dir: str) -> Field:
    orders = table(spark, sf_dir, "orders")
    cells = packed_cells(orders, F.month("o_orderdate"), F.lit(0), F.col("o_custkey") % LATS, F.col("o_orderkey") % LONS, F.col("o_totalprice"), 120000.0)
    return Field("MONTHLY", "Salinity", "s_an", Layout(latitudes(), longitudes(), None, PACKING, ("lat", "lon")), cells, "PSU", None, True, "woa", "s{MM}_04.nc")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    month = F.when(F.col("event_id") % 5 != 0, F.make_timestamp_ntz(F.lit(2024), (F.col("event_id") % 12 + 1).cast("int"), F.lit(15), F.lit(12), F.lit(0), F.lit(0)))
    return e.select(
        F.col("event_id").alias("query_id"),
        ((F.col("user_id") * 37) % 181 - 90).cast("double").alias("latitude"),
        ((F.col("event_id") * 53) % 721 - 360).cast("double").alias("longitude"),
        F.when(F.col("event_id") % 7 != 0, ((F.col("event_id") * 13) % 600).cast("double")).alias("depth"),
        month.alias("date_time"),
        F.lit("Nearest").alias("sampling"),
    )
