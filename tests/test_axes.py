"""The nearest-place contract, in all its forms."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seagrid.errors import GridDataError
from seagrid.functions.axes import axis_bounds, axis_form, bisect_nearest, nearest_index, normalize_longitude

INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    ("axis", "target", "place"),
    [
        ([0, 10, 20], 5, 0),  # a tie goes to the lower place
        ([20, 10, 0], 5, 1),
        ([7], 99, 0),
        ([7], NAN, 0),
        ([0, 10, 20], -5, 0),
        ([0, 10, 20], 1e20, 2),
        ([0, 10, 20], -INF, 0),
        ([0, 10, 20], INF, 2),
        ([20, 10, 0], INF, 0),
        ([0, 10, 20], NAN, 0),
        ([20, 10, 0], NAN, 0),
        ([0, 10, 20], 10, 1),
        ([0, 10, 20], 5.1, 1),
        ([3, 3, 2, 1], 3, 1),
        ([6, 1, 7, 4, 1, 5], 6.5, 2),
    ],
)
def test_bisect_vectors(axis, target, place):
    assert bisect_nearest(np.array(axis, float), np.array([target], float)).tolist() == [place]


def test_empty_axis_fails():
    with pytest.raises(GridDataError):
        bisect_nearest(np.zeros(0), np.zeros(1))
    with pytest.raises(GridDataError):
        axis_form(np.zeros(0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-8000, 8000).map(lambda k: k / 8), min_size=2, max_size=40, unique=True), st.lists(st.integers(-32000, 32000).map(lambda k: k / 16), min_size=1, max_size=20), st.booleans())
def test_bisect_is_the_nearest_of_a_linear_scan(values, targets, rising):
    axis = np.array(sorted(values, reverse=not rising))
    for target, place in zip(targets, bisect_nearest(axis, np.array(targets)).tolist()):
        gaps = np.abs(axis - target)
        assert gaps[place] == gaps.min()
        exact = np.flatnonzero(axis == target)
        assert place == (exact[0] if len(exact) else np.flatnonzero(gaps == gaps.min())[0])


TARGETS = [0.0, -0.1, 5.0, 10.0, 14.999, 15.0, 15.001, 179.9, 359.875, 359.9, -1e20, 1e20, INF, -INF, NAN, None]


@pytest.mark.parametrize("axis", [np.arange(0, 360, 0.25), np.arange(0, 360, 0.25)[::-1], np.array([0, 10, 50, 100, 500.0]), np.array([500, 100, 50, 10, 0.0]), np.linspace(-180, 180, 1441), np.array([3.0]), np.linspace(-90, 90, 181) + 1e-4 * np.sin(np.arange(181))])
def test_forms_agree(spark, axis):
    axis = np.ascontiguousarray(axis)
    rng = np.random.default_rng(1)
    targets = TARGETS + rng.uniform(axis.min() - 1, axis.max() + 1, 200).tolist() + ((axis[:-1] + axis[1:]) / 2)[:50].tolist() + axis[:50].tolist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "i int, t double")
    from pyspark.sql import functions as F

    form = axis_form(axis)
    names = sorted({form, "bisect"} | ({"short"} if form in ("short", "uniform") and len(axis) < 2000 else set()))
    got = df.select("i", *(nearest_index(F.col("t"), axis, n).alias(n) for n in names)).orderBy("i").collect()
    want = [None if t is None else int(bisect_nearest(axis, np.array([t]))[0]) for t in targets]
    for n in names:
        assert [r[n] for r in got] == want, n


@pytest.mark.parametrize(
    ("low", "high", "given_", "turned"),
    [(0, 359.75, -0.1, 359.9), (0, 359.75, 10, 10), (-180, 180, 190, -170), (-180, 180, -190, -190), (-180, 181, 190, 190), (120, 135, -10, -10), (0, 359, -0.0, 0.0)],
)
def test_longitudes(spark, low, high, given_, turned):
    from pyspark.sql import functions as F

    assert spark.range(1).select(normalize_longitude(F.lit(float(given_)), low, high)).first()[0] == turned


def test_nan_longitude_stays(spark):
    from pyspark.sql import functions as F

    assert math.isnan(spark.range(1).select(normalize_longitude(F.lit(NAN), -180.0, 180.0)).first()[0])
    assert all(math.isnan(b) for b in axis_bounds(np.array([1.0, NAN])))
