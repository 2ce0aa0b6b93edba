"""Rounding as NumPy and as Python do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(x: Column | str, digits: int) -> Column:
    """rint(x * 10**digits) / 10**digits: ties to even after scaling."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def exact_round(x: float | None, digits: int) -> float | None:
    """Round the exact binary value; for the few rows that reach the driver."""
    return None if x is None else round(x, digits)
