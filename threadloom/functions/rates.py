"""Rates: null where undefined, or zero by convention; the Wilson interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(rate_or_null(part, whole), F.lit(0.0))


def wilson(success: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; null without trials."""
    n, p = total.cast("double"), rate_or_null(success, total)
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    known = total > 0
    return F.when(known, F.greatest(F.lit(0.0), middle - half)), F.when(known, F.least(F.lit(1.0), middle + half))
