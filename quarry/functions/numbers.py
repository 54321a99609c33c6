"""Number helpers whose results don't depend on the order of rows or on an engine's rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """x rounded half up to so many digits, as double: floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x.cast("double") * 10.0**digits + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def ratio(num: Column, den: Column, digits: int | None = None, scale: float = 1.0) -> Column:
    """num / den * scale; null where den is 0 or null; rounded half up if digits is given."""
    q = num.cast("double") * F.lit(float(scale)) / F.nullif(den.cast("double"), F.lit(0.0))
    return q if digits is None else half_up(q, digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def points(*steps: tuple[Column, float], otherwise: float = 0) -> Column:
    """The points of the first condition that holds."""
    out = F
    for condition, p in steps:
        out = out.when(condition, F.lit(p))
    return out.otherwise(F.lit(otherwise))
