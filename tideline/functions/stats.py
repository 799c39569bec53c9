"""Return and moment expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_return(now: Column, before: Column) -> Column:
    """``now / before - 1``; NULL when either is absent or ``before`` is 0."""
    return F.try_divide(now, before) - 1


def half_up(x: Column, digits: int = 0) -> Column:
    """``round(x, digits)`` to the same double, without decimal arithmetic unless the value is large or near a tie."""
    scaled = x * 10.0**digits
    near = F.rint(scaled)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - near) < 0.4999)
    # Adding zero makes -0.0 the 0.0 that round() gives.
    return F.when(clear, near / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(x, digits))


def unbiased_skewness(x: Column, over=None) -> Column:
    """Bias-corrected skewness (needs three values).

    Spark's own ``skewness`` is the population figure. Works as a group
    aggregate or, given a window, as a window aggregate.
    """
    n, g = _windowed(F.count(x), over), _windowed(F.skewness(x), over)
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * g)


def unbiased_kurtosis(x: Column, over=None) -> Column:
    """Bias-corrected excess kurtosis (needs four values)."""
    n, g = _windowed(F.count(x), over), _windowed(F.kurtosis(x), over)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def _windowed(agg: Column, over) -> Column:
    return agg if over is None else agg.over(over)


def span_decay(span: float) -> float:
    """Per-step weight factor of an exponentially weighted mean of this span."""
    return 1.0 - 2.0 / (span + 1.0)
