"""Months and monthly files."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_or_now(date_time: Column, now: datetime) -> Column:
    """The month of the time asked for, or of ``now``."""
    return F.coalesce(F.month(date_time), F.lit(now.month)).cast("int")


def month_file(pattern: Column, month: Column) -> Column:
    """The pattern with every ``{MM}`` replaced by the two-digit month."""
    return F.replace(pattern, F.lit("{MM}"), F.lpad(month.cast("string"), 2, "0"))


def resolve_file(path: str, pattern: str | None, month: int) -> str:
    """The file of a month: the path itself without a pattern."""
    if not (pattern or "").strip():
        return path
    return os.path.join(path, pattern.replace("{MM}", f"{month:02d}"))


def mid_month(year: Column, month: Column) -> Column:
    """Noon of the 15th of a month that is brought into 1 to 12."""
    inside = F.least(F.greatest(month, F.lit(1)), F.lit(12))
    return F.make_timestamp_ntz(year, inside, F.lit(15), F.lit(12), F.lit(0), F.lit(0))
