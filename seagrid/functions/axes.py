"""Nearest position on an axis.

An axis is searched as by bisection, whatever its order: an exact hit ends the
search, else the two places around the gap compete and the upper one wins only if it
is strictly nearer. Targets beyond the ends take the end; a NaN target takes place 0.

Three forms give the same answer:

* ``uniform`` axes (nearly equal steps): the place is computed and corrected by its
  neighbours, all in JVM expressions;
* short strictly monotonic axes: a count of smaller values, in JVM expressions;
* all others, unsorted ones too: a vectorized bisection in an Arrow function.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from seagrid.errors import GridDataError

SHORT_AXIS = 64
LITERAL_AXIS = 65_536


def bisect_nearest(axis: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The place of each target on the axis (the reference form of the search)."""
    n = len(axis)
    if n == 0:
        raise GridDataError("Coordinate axis is empty.")
    if n == 1:
        return np.zeros(len(target), np.int64)
    rising = bool(axis[-1] >= axis[0])
    low, high = np.zeros(len(target), np.int64), np.full(len(target), n - 1)
    exact = np.full(len(target), -1)
    live = np.arange(len(target))
    with np.errstate(invalid="ignore"):
        while len(live):
            mid = low[live] + (high[live] - low[live]) // 2
            value, t = axis[mid], target[live]
            hit = value == t
            exact[live[hit]] = mid[hit]
            up = (value < t) if rising else (value > t)
            low[live] = np.where(up, mid + 1, low[live])
            high[live] = np.where(up, high[live], mid - 1)
            live = live[~hit & (low[live] <= high[live])]
        at = np.clip(low, 1, n - 1)
        nearer = np.abs(axis[at] - target) < np.abs(axis[at - 1] - target)
    between = np.where(nearer, at, at - 1)
    return np.where(exact >= 0, exact, np.where(low <= 0, 0, np.where(low >= n, n - 1, between)))


def axis_form(axis: np.ndarray) -> str:
    """Which form of the search suits an axis: single, uniform, short or bisect."""
    n = len(axis)
    if n == 0:
        raise GridDataError("Coordinate axis is empty.")
    if n == 1:
        return "single"
    steps = np.diff(axis)
    strict = np.isfinite(axis).all() and ((steps > 0).all() or (steps < 0).all())
    if not strict:
        return "bisect"
    if n <= SHORT_AXIS:
        return "short"
    even = axis[0] + (axis[-1] - axis[0]) * (np.arange(n) / (n - 1))
    if n <= LITERAL_AXIS and np.abs(axis - even).max() < abs(axis[-1] - axis[0]) / (n - 1) / 4:
        return "uniform"
    return "bisect"


def axis_literal(axis: np.ndarray) -> Column:
    """The axis as one array expression, which the optimizer folds to a constant."""
    return F.split(F.lit(",".join(map(repr, axis.astype(float).tolist()))), ",").cast("array<double>")


def nearest_index(target: Column, axis: np.ndarray, form: str | None = None) -> Column:
    """The 0-based place on ``axis`` nearest to ``target`` (null for a null target)."""
    axis = np.asarray(axis, np.float64)
    form = form or axis_form(axis)
    n = len(axis)
    if form == "single":
        return F.when(target.isNotNull(), F.lit(0))
    if form == "bisect":

        @F.pandas_udf("int")
        def search(values):
            import pandas as pd

            # Arrow turns nulls into NaN, whose answer the outer condition hides.
            return pd.Series(bisect_nearest(axis, values.to_numpy(np.float64)).astype(np.int32))

        return F.when(target.isNotNull(), search(target))
    values = axis_literal(axis)
    rising = bool(axis[-1] >= axis[0])
    if form == "short":
        low = F.size(F.filter(values, lambda v: v < target if rising else v > target))
    else:
        step = (axis[-1] - axis[0]) / (n - 1)
        guess = F.ceil(F.least(F.greatest((target - float(axis[0])) / F.lit(step), F.lit(-2.0)), F.lit(n + 2.0))).cast("int")
        before = lambda i: F.get(values, i) < target if rising else F.get(values, i) > target
        # The count of values before the target lies within two of the guess.
        low = F.greatest(guess - 2, F.lit(0))
        count = F.lit(0)
        for k in range(5):
            at = low + k
            count = count + F.when((at < n) & before(at), 1).otherwise(0)
        low = F.least(low, F.lit(n)) + count
    here, there = F.get(values, low), F.get(values, low - 1)
    chosen = F.when(low <= 0, 0).when(low >= n, n - 1).when(here == target, low).when(F.abs(here - target) < F.abs(there - target), low).otherwise(low - 1)
    return F.when(target.isNull(), None).when(F.isnan(target), 0).otherwise(chosen).cast("int")


def axis_value(axis: np.ndarray, index: Column) -> Column:
    """The axis value at a place."""
    axis = np.asarray(axis, np.float64)
    if len(axis) <= LITERAL_AXIS:
        return F.get(axis_literal(axis), index)

    @F.pandas_udf("double")
    def take(at):
        import pandas as pd

        good = at.notna()
        return pd.Series(np.where(good, axis[at.fillna(0).to_numpy(np.int64)], np.nan)).where(good)

    return take(index)


def normalize_longitude(longitude: Column, low: float, high: float) -> Column:
    """Shift a longitude by a turn if the axis, from ``low`` to ``high``, asks for it."""
    if low >= 0 and high > 180:
        return F.when(~F.isnan(longitude) & (longitude < 0), longitude + 360).otherwise(longitude)
    if low < 0 and high <= 180:
        return F.when(~F.isnan(longitude) & (longitude > 180), longitude - 360).otherwise(longitude)
    return longitude


def axis_bounds(axis: np.ndarray) -> tuple[float, float]:
    """Smallest and largest value; NaN if any is NaN, as a comparison of all values gives."""
    if not len(axis):
        raise GridDataError("Coordinate axis is empty.")
    return (math.nan, math.nan) if np.isnan(axis).any() else (float(np.min(axis)), float(np.max(axis)))
