"""One-period, calendar-lag and cumulative returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import simple_return
from tideline.operators.panel import by_time, ffill, shifted

# Horizon name -> fraction of the year length.
HORIZON_FRACTIONS = {"3month": 0.25, "6month": 0.5, "9month": 0.75, "1yr": 1, "3yr": 3, "5yr": 5}


def horizons(trading_days: int = 252) -> dict[str, int]:
    """Horizon lengths in calendar days for a year of ``trading_days``."""
    return {name: round(trading_days * f) for name, f in HORIZON_FRACTIONS.items()}


def daily_returns(panel: DataFrame, keys: Sequence[str] = ("asset",), value: str = "price") -> DataFrame:
    """One-period return ``r`` of the forward-filled value ``px``.

    A gap gives 0 and the first price after it spans the gap.
    """
    filled = ffill(panel, keys, value)
    return filled.withColumn("r", simple_return(F.col("px"), F.lag("px").over(by_time(*keys))))


def lagged_returns(
    panel: DataFrame, lags: Mapping[str, int] | None = None, keys: Sequence[str] = ("asset",), value: str = "price"
) -> DataFrame:
    """``Return_<h>`` in percent against the price exactly ``k`` days earlier."""
    lags = lags or horizons()
    filled = panel if "px" in panel.columns else ffill(panel, keys, value)
    return filled.withColumns(
        {f"Return_{h}": simple_return(F.col("px"), shifted("px", keys, k)) * 100 for h, k in lags.items()}
    )


def cumulative_return(
    panel: DataFrame, keys: Sequence[str] = ("asset",), value: str = "price", out: str = "Cum_Return"
) -> DataFrame:
    """Compounded one-period returns in percent, NULL on the first known price.

    The product of ``1 + r`` telescopes to ``px / first px``, which needs one
    running aggregate and gathers no rounding error along the way.
    """
    filled = panel if "px" in panel.columns else ffill(panel, keys, value)
    running = by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)
    origin = F.first("px", ignorenulls=True).over(running)
    started = F.lag("px").over(by_time(*keys)).isNotNull()
    return filled.withColumn(out, F.when(started, simple_return(F.col("px"), origin) * 100))


def multi_period_return(returns: DataFrame, keys: Sequence[str] = ("asset",), value: str = "r") -> DataFrame:
    """Compounded return per group; a group without any return gives 0."""
    return returns.groupBy(*keys).agg((F.coalesce(F.product(F.col(value) + 1), F.lit(1.0)) - 1).alias("total_return"))
