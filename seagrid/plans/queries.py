"""The registered queries: every operator of the engine over derived fields, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.functions import display
from seagrid.functions.axes import nearest_index, normalize_longitude
from seagrid.functions.decode import Packing, unpack
from seagrid.functions.timefile import mid_month, month_file
from seagrid.operators import points as P
from seagrid.operators import raster as R
from seagrid.plans import fields as D
from seagrid.sources.registry import default_source, last_definitions, successful

NOW = datetime(2024, 8, 15, 12)
SPEC = R.GridSpec(-70.0, 70.0, -25.0, 345.0, width=60, height=40)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# SQL pieces


def sql_nearest(axis: str, n: int, t: str, rising: bool = True) -> str:
    """The place nearest to t on a strictly monotonic axis (a list)."""
    low = f"len(list_filter({axis}, lambda v: v {'<' if rising else '>'} {t}))"
    return (
        f"(CASE WHEN isnan({t}) THEN 0 WHEN {low} = 0 THEN 0 WHEN {low} >= {n} THEN {n - 1} WHEN {axis}[{low} + 1] = {t} THEN {low} "
        f"WHEN abs({axis}[{low} + 1] - {t}) < abs({axis}[{low}] - {t}) THEN {low} ELSE {low} - 1 END)"
    )


LAT = "list_transform(range(25), lambda x: -60e0 + 5e0 * x)"
LON = "list_transform(range(36), lambda x: 10e0 * x)"
DEPTH = "[0e0, 10e0, 50e0, 100e0, 500e0]"
AXES = f"ax AS (SELECT {LAT} AS lat, {LON} AS lon, {DEPTH} AS dep)"
SHIFTED = "(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END)"
RAW = "CASE WHEN min({amount}) > {limit} THEN -32768e0 ELSE CAST(floor(min({amount}) / 100) AS DOUBLE) END AS raw"
VALUE = "CASE WHEN raw IS NULL OR raw = -32768 THEN NULL ELSE raw * 0.01e0 + 5e0 END"
PRICE = f"cells AS (SELECT o_custkey % 25 AS i, o_orderkey % 36 AS j, {RAW.format(amount='o_totalprice', limit=60000)} FROM orders GROUP BY 1, 2)"
QUANTITY = f"cells2 AS (SELECT l_partkey % 25 AS i, l_orderkey % 36 AS j, {RAW.format(amount='l_extendedprice', limit=2000)} FROM lineitem GROUP BY 1, 2)"
POINTS = (
    "pts AS (SELECT event_id AS query_id, CAST((user_id * 37) % 181 - 90 AS DOUBLE) AS la, CAST((event_id * 53) % 721 - 360 AS DOUBLE) AS lon, "
    "CASE WHEN event_id % 7 <> 0 THEN CAST((event_id * 13) % 600 AS DOUBLE) END AS de, CASE WHEN event_id % 5 <> 0 THEN event_id % 12 + 1 ELSE 8 END AS mo FROM events)"
)
INDEXED = f"idx AS (SELECT pts.*, ax.lat, ax.lon AS axlon, ax.dep, {sql_nearest('ax.lat', 25, 'la')} AS i, {sql_nearest('ax.lon', 36, SHIFTED.replace('lon', 'pts.lon'))} AS j, {sql_nearest('ax.dep', 5, 'coalesce(de, 0e0)')} AS d FROM pts, ax)"
GRID = (
    f"g AS (SELECT r.x AS row, c.x AS col, 70e0 + (-70e0 - 70e0) * (r.x / 39e0) AS la, -25e0 + (345e0 - -25e0) * (c.x / 59e0) AS lon FROM range(40) r(x), range(60) c(x)), "
    f"gi AS (SELECT g.row, g.col, ax.*, {sql_nearest('ax.lat', 25, 'la')} AS i, {sql_nearest('ax.lon', 36, SHIFTED.replace('lon', 'g.lon'))} AS j FROM g, ax), "
    f"grid AS (SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, lat[gi.i + 1] AS latitude, lon[gi.j + 1] AS longitude, {VALUE} AS value FROM gi LEFT JOIN cells USING (i, j))"
)


# Points


@query(f"WITH {AXES}, {POINTS}, {INDEXED}, {PRICE} SELECT query_id, {VALUE} AS value, lat[i + 1] AS latitude, axlon[j + 1] AS longitude FROM idx LEFT JOIN cells USING (i, j)")
def point_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.nearest_points(D.event_points(spark, sf_dir), D.price_field(spark, sf_dir), now=NOW)
    return found.select("query_id", "value", "latitude", "longitude")


_MID = "-62.5e0 + 5e0 * (event_id % 27)"


@query(f"WITH {AXES} SELECT event_id, CAST({sql_nearest('lat', 25, f'({_MID})')} AS INTEGER) AS rising, CAST({sql_nearest('list_reverse(lat)', 25, f'({_MID})', False)} AS INTEGER) AS falling FROM events, ax")
def point_descending_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.lit(-62.5) + F.lit(5.0) * (F.col("event_id") % 27)
    up = D.latitudes()
    return D.table(spark, sf_dir, "events").select("event_id", nearest_index(target, up).alias("rising"), nearest_index(target, up[::-1].copy()).alias("falling"))


@query("SELECT event_id, CAST(CASE WHEN x <= -180 THEN 0 WHEN x >= 180 THEN 1440 ELSE CASE WHEN 4 * (x + 180) - floor(4 * (x + 180)) > 0.5 THEN floor(4 * (x + 180)) + 1 ELSE floor(4 * (x + 180)) END END AS INTEGER) AS at FROM (SELECT event_id, ((event_id * 7919) % 400001 - 200000) / 1024e0 AS x FROM events)")
def axis_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = ((F.col("event_id") * 7919) % 400001 - 200000) / F.lit(1024.0)
    return D.table(spark, sf_dir, "events").select("event_id", nearest_index(target, np.arange(1441) / 4.0 - 180.0, "uniform").alias("at"))


@query(
    f"WITH {AXES}, {POINTS}, {INDEXED}, cells AS (SELECT o_orderkey % 5 AS d, o_custkey % 25 AS i, CAST(floor(o_orderkey / 5e0) AS BIGINT) % 36 AS j, {RAW.format(amount='o_totalprice', limit=90000)} FROM orders GROUP BY 1, 2, 3) "
    f"SELECT query_id, {VALUE} AS value, dep[d + 1] AS depth FROM idx LEFT JOIN cells USING (d, i, j)"
)
def point_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nearest_points(D.event_points(spark, sf_dir), D.depth_field(spark, sf_dir), now=NOW).select("query_id", "value", "depth")


@query(
    f"WITH {AXES}, {POINTS}, {INDEXED}, cells AS (SELECT month(o_orderdate) AS mo, o_custkey % 25 AS i, o_orderkey % 36 AS j, {RAW.format(amount='o_totalprice', limit=120000)} FROM orders GROUP BY 1, 2, 3) "
    f"SELECT query_id, {VALUE} AS value, 'woa/s' || lpad(CAST(mo AS VARCHAR), 2, '0') || '_04.nc' AS file FROM idx LEFT JOIN cells USING (mo, i, j)"
)
def month_partitioned_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.nearest_points(D.event_points(spark, sf_dir), D.monthly_field(spark, sf_dir), now=NOW)
    return found.select("query_id", "value", F.col("metadata")["file"].alias("file"))


@query(
    f"WITH {AXES}, {POINTS}, {INDEXED}, {PRICE}, {QUANTITY}, u AS (SELECT query_id, 'PRICE' AS source_id, {VALUE} AS value FROM idx JOIN cells USING (i, j) UNION ALL SELECT query_id, 'QUANTITY', {VALUE} FROM idx JOIN cells2 USING (i, j)) "
    "SELECT * FROM u WHERE value IS NOT NULL"
)
def fanout_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [D.price_field(spark, sf_dir), D.quantity_field(spark, sf_dir)]
    return P.nearest_in_all(D.event_points(spark, sf_dir), both, now=NOW).select("query_id", "source_id", "value")


@query(
    f"WITH {AXES}, {POINTS} SELECT query_id, k AS key, CASE k WHEN 'dataset' THEN 'orders' WHEN 'file' THEN 'orders.parquet' ELSE 'Nearest' END AS value FROM pts, (SELECT unnest(['dataset', 'file', 'sampling']) AS k)"
)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.nearest_points(D.event_points(spark, sf_dir), D.price_field(spark, sf_dir), now=NOW)
    return found.select("query_id", F.explode("metadata"))


@query(
    "SELECT event_id, (la BETWEEN -90 AND 90) AS latitude_ok, (lo BETWEEN -360 AND 360) AS longitude_ok FROM (SELECT event_id, CAST((user_id * 37) % 221 - 110 AS DOUBLE) AS la, CAST((event_id * 53) % 801 - 400 AS DOUBLE) AS lo FROM events)"
)
def validate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") * 37) % 221 - 110).cast("double").alias("la"), ((F.col("event_id") * 53) % 801 - 400).cast("double").alias("lo"))
    return e.select("event_id", P.valid_latitude(F.col("la")).alias("latitude_ok"), P.valid_longitude(F.col("lo")).alias("longitude_ok"))


_TURN = "SELECT event_id, CASE WHEN {test} THEN {shifted} ELSE x END AS longitude FROM (SELECT event_id, CAST((event_id * 53) % 721 - 360 AS DOUBLE) AS x FROM events)"


def _turned(spark: SparkSession, sf_dir: str, low: float, high: float) -> DataFrame:
    x = ((F.col("event_id") * 53) % 721 - 360).cast("double")
    return D.table(spark, sf_dir, "events").select("event_id", normalize_longitude(x, low, high).alias("longitude"))


@query(_TURN.format(test="x < 0", shifted="x + 360"))
def lon_normalize_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turned(spark, sf_dir, 0.0, 359.75)


@query(_TURN.format(test="x > 180", shifted="x - 360"))
def lon_normalize_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turned(spark, sf_dir, -180.0, 180.0)


@query("SELECT o_orderkey, CASE WHEN raw = -32768 OR raw = -999 THEN NULL ELSE raw * 0.01e0 + 273.15e0 END AS value FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN -32768e0 WHEN 1 THEN -999e0 ELSE floor(o_totalprice) END AS raw FROM orders)")
def cf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 10 == 0, -32768.0).when(F.col("o_orderkey") % 10 == 1, -999.0).otherwise(F.floor("o_totalprice").cast("double"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", unpack(raw, Packing(-32768.0, -999.0, 0.01, 273.15)).alias("value"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings")
def extra_dims_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that no axis moves stand at 0."""
    return D.table(spark, sf_dir, "embeddings").select("vec_id", F.get(F.col("embedding").cast("array<double>"), 0).alias("value"))


# Rasters


@query(f"WITH {AXES}, {PRICE}, {GRID} SELECT * FROM grid")
def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.raster_cells(D.price_field(spark, sf_dir), SPEC, now=NOW).drop("source_id")


@query(f"WITH {AXES}, {PRICE}, {GRID} SELECT CAST(60 AS INTEGER) AS width, CAST(40 AS INTEGER) AS height, min(value) AS minimum, max(value) AS maximum FROM grid")
def grid_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.raster_summary(D.price_field(spark, sf_dir), SPEC, now=NOW).select("width", "height", "minimum", "maximum")


@query(f"WITH {AXES}, {PRICE}, {GRID} SELECT value FROM grid WHERE row = 17 AND col = 42")
def grid_get_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_value(grid_sample(spark, sf_dir), SPEC, 17, 42)


@query(
    "SELECT event_id, CAST(least(greatest(floor(least(greatest(y / 300e0, 0e0), 0.999999e0) * 40), 0), 39) AS INTEGER) AS row, CAST(least(greatest(floor(least(greatest(x / 500e0, 0e0), 0.999999e0) * 60), 0), 59) AS INTEGER) AS col "
    "FROM (SELECT event_id, (event_id * 17) % 700 - 100e0 AS x, (event_id * 29) % 500 - 100e0 AS y FROM events)"
)
def raster_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") * 17) % 700 - 100.0, (F.col("event_id") * 29) % 500 - 100.0
    at = display.raster_cell(x, y, 500.0, 300.0, SPEC.width, SPEC.height)
    return D.table(spark, sf_dir, "events").select("event_id", at.alias("at")).select("event_id", F.col("at.row").alias("row"), F.col("at.column").alias("col"))


def _sql_channel(k: int) -> str:
    parts = [f"WHEN t <= {b[0]}e0 THEN round_even({float(a[k])}e0 + {float(b[k] - a[k])}e0 * ((t - {a[0]}e0) / ({b[0]}e0 - {a[0]}e0)), 0)" for a, b in zip(display.RAMP, display.RAMP[1:])]
    return f"CASE WHEN value IS NULL THEN 230 {' '.join(parts)} ELSE {display.RAMP[-1][k]} END"


@query(
    f"WITH {AXES}, {PRICE}, {GRID}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM grid), u AS (SELECT row, col, value, least(greatest((value - lo) / greatest(hi - lo, 1e-12), 0e0), 1e0) AS t FROM grid, m) "
    f"SELECT row, col, CAST({_sql_channel(1)} AS INTEGER) AS r, CAST({_sql_channel(2)} AS INTEGER) AS g, CAST({_sql_channel(3)} AS INTEGER) AS b FROM u"
)
def color_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_sample(spark, sf_dir)
    low, high = (cells.agg(f.alias("v")).scalar() for f in (R.nan_min(F.col("value")), F.max("value")))
    return cells.select("row", "col", display.value_colour(F.col("value"), low, high).alias("c")).select("row", "col", "c.r", "c.g", "c.b")


@query(f"WITH {AXES}, {PRICE}, {GRID} SELECT row, col, coalesce(rtrim(rtrim(printf('%.5f', value), '0'), '.'), 'NoData') AS text FROM grid")
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_sample(spark, sf_dir).select("row", "col", display.format_value(F.col("value")).alias("text"))


@query("SELECT event_id, TRY_CAST(trim(t) AS DOUBLE) AS d, TRY_CAST(t2 AS INTEGER) AS i FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || CAST(event_id / 8e0 AS VARCHAR) || ' ' WHEN 1 THEN event_type ELSE '-12.5' END AS t, CASE event_id % 2 WHEN 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS t2 FROM events)")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.concat(F.lit(" "), (n / F.lit(8.0)).cast("string"), F.lit(" "))).when(n % 3 == 1, F.col("event_type")).otherwise(F.lit("-12.5"))
    whole = F.when(n % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return D.table(spark, sf_dir, "events").select("event_id", display.parse_double(text).alias("d"), display.parse_int(whole).alias("i"))


# Time and files


@query("SELECT o_orderkey, 't' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '_' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '.nc' AS file FROM orders")
def month_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select("o_orderkey", month_file(F.lit("t{MM}_{MM}.nc"), F.month("o_orderdate")).alias("file"))


@query("SELECT event_id, CAST(month(make_timestamp(2024, least(greatest(event_id % 20 - 3, 1), 12), 15, 12, 0, 0)) AS INTEGER) AS mo, CAST(15 AS INTEGER) AS da FROM events")
def month_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = mid_month(F.lit(2024), (F.col("event_id") % 20 - 3).cast("int"))
    return D.table(spark, sf_dir, "events").select("event_id", F.month(at).alias("mo"), F.dayofmonth(at).alias("da"))


# Registry

_DEFINED = "SELECT CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END || CAST(c_nationkey AS VARCHAR) AS id, c_custkey AS position, CASE c_custkey % 4 WHEN 0 THEN 'Disabled' WHEN 1 THEN 'Error' ELSE 'Ready' END AS status FROM customer"
_LAST = f"l AS (SELECT id, position, status FROM (SELECT *, row_number() OVER (PARTITION BY lower(id) ORDER BY position DESC) AS n FROM ({_DEFINED})) WHERE n = 1)"


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = D.table(spark, sf_dir, "customer"), F.col("c_custkey")
    segment = F.col("c_mktsegment")
    cased = F.when(key % 3 == 0, F.upper(segment)).when(key % 3 == 1, F.lower(segment)).otherwise(segment)
    status = F.when(key % 4 == 0, "Disabled").when(key % 4 == 1, "Error").otherwise("Ready")
    return c.select(F.concat(cased, F.col("c_nationkey").cast("string")).alias("id"), key.alias("position"), status.alias("status"))


@query(f"WITH {_LAST} SELECT id, position, status FROM l")
def registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_definitions(_defined(spark, sf_dir))


@query(f"WITH {_LAST} SELECT status, count(*) AS n FROM l GROUP BY status")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_definitions(_defined(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_LAST} SELECT id, status FROM l WHERE lower(id) = lower('Building7')")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_definitions(_defined(spark, sf_dir)).filter(F.lower("id") == F.lower(F.lit("Building7"))).select("id", "status")


@query(f"WITH {_LAST} SELECT coalesce(bool_and(status IN ('Ready', 'Disabled')), true) AS success FROM l")
def init_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successful(last_definitions(_defined(spark, sf_dir)))


@query(f"WITH {_LAST} SELECT id, status FROM l ORDER BY (status <> 'Ready')::INTEGER, id LIMIT 1")
def default_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_source(last_definitions(_defined(spark, sf_dir))).select("id", "status")
