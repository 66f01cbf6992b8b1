import math

import pytest
from pyspark.sql import functions as F

from seagrid.functions import display
from seagrid.functions.decode import Packing, nearly_equal, unpack

EDGE = [0.0, 1.0, -1.0, 1e-13, 1e-11, -32768.0, -32768.0 * (1 + 1e-13), 1e20, 1e20 * (1 + 1e-13), math.inf, -math.inf, math.nan, 9.96921e36]


def scalar(a, b):
    same = a == b or (math.isnan(a) and math.isnan(b))
    return same or abs(a - b) <= max(1e-12, abs(b) * 1e-12)


def test_nearly_equal_on_all_pairs(spark):
    df = spark.createDataFrame([(x,) for x in EDGE], "x double")
    for mark in EDGE:
        got = [r[0] for r in df.select(nearly_equal(F.col("x"), mark)).collect()]
        assert got == [scalar(x, mark) for x in EDGE], mark


@pytest.mark.parametrize(
    ("raw", "packing", "value"),
    [
        (5.0, Packing(), 5.0),
        (-1.0, Packing(fill=-1.0), None),
        (-1.0, Packing(missing=-1.0), None),
        (5.0, Packing(fill=-1.0, scale=2.0), 10.0),
        (5.0, Packing(offset=1.0), 6.0),
        (5.0, Packing(-1.0, -2.0, 0.1, 3.0), 5.0 * 0.1 + 3.0),
        (1.0, Packing(fill=math.inf), None),
        (1e-13, Packing(fill=0.0), None),
        (1e-11, Packing(fill=0.0), 1e-11),
        (math.nan, Packing(fill=math.nan), None),
        (None, Packing(fill=1.0), None),
    ],
)
def test_unpack(spark, raw, packing, value):
    assert spark.createDataFrame([(raw,)], "x double").select(unpack(F.col("x"), packing)).first()[0] == value


def test_nan_without_fill_stays(spark):
    assert math.isnan(spark.createDataFrame([(math.nan,)], "x double").select(unpack(F.col("x"), Packing())).first()[0])


def test_display(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (0.0,), (0.5,), (1.0,), (7.0,)], "v double")
    rows = [tuple(r[0]) for r in df.select(display.value_colour(F.col("v"), F.lit(0.0), F.lit(1.0))).collect()]
    assert rows[0] == rows[1] == (230, 230, 230)
    assert rows[2] == (48, 18, 59) and rows[4] == rows[5] == (180, 4, 38)
    assert rows[3] == (90, 194, 124)  # 90.5 and 124.5 go to even
    text = [r[0] for r in spark.createDataFrame([(None,), (1.5,), (0.1234567,), (-2.0,)], "v double").select(display.format_value(F.col("v"))).collect()]
    assert text == ["NoData", "1.5", "0.12346", "-2"]
    assert spark.range(1).select(display.depth_label(F.lit(12.5))).first()[0] == "12.5 m"
    cell = spark.range(1).select(display.raster_cell(F.lit(-4.0), F.lit(1e9), 500.0, 300.0, 60, 40)).first()[0]
    assert tuple(cell) == (39, 0)


def test_texts_of_any_kind_and_strict_numbers(spark):
    from seagrid.functions.display import format_any, parse_double, parse_int

    row = spark.sql("SELECT 1D AS a, 0.1234567D AS b, CAST(2.5 AS FLOAT) AS c, 7 AS d, 'x' AS e, CAST(NULL AS DOUBLE) AS f, true AS g")
    assert list(row.select(*(format_any(F.col(c)).alias(c) for c in "abcdefg")).first()) == ["1", "0.12346", "2.5", "7", "x", "NoData", "True"]
    texts = [" 1.5 ", "1d", "2.5f", "0x1p3", "1e3", ".5", "5.", "", None, "-7", "+7", "1 2", "NaN", "2147483648"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_double(F.col("t")), parse_int(F.col("t"))).collect()
    assert [None if r[0] is None else str(r[0]) for r in got] == ["1.5", None, None, None, "1000.0", "0.5", "5.0", None, None, "-7.0", "7.0", None, "nan", "2147483648.0"]
    assert [r[1] for r in got] == [None] * 9 + [-7, 7, None, None, None]
