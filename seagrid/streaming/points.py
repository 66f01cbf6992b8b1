"""Nearest-value lookup of a stream of points: a stream-static join by the batch plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from seagrid.operators.points import nearest_points
from seagrid.sources.field import Field


def stream_points(points: DataFrame, field: Field, now: datetime) -> DataFrame:
    """As ``nearest_points``, for a streaming frame; ``now`` stands for the time of points without one."""
    if not points.isStreaming:
        raise ValueError("a streaming frame is required")
    return nearest_points(points, field, now=now)
