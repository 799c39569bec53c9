"""Summary statistics, histograms and comparisons of series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.stats import simple_return, unbiased_kurtosis, unbiased_skewness
from tideline.operators.panel import by_time, ffill, wide
from tideline.operators.resample import resample
from tideline.operators.returns import cumulative_return, daily_returns

# Histogram bins per frequency.
BINS = {"daily": 40, "monthly": 20, "quarterly": 10, "annual": 7}


def period_returns(
    values: DataFrame, freqs: Sequence[str], keys: Sequence[str] = ("portfolio",), value: str = "value"
) -> DataFrame:
    """Returns of the period means of each series, one block of rows per frequency.

    ``first_value`` and ``last_value`` carry the first and last daily value of
    each period along for overall returns.
    """
    known = values.where(F.col(value).isNotNull())
    periods = resample(
        known,
        freqs,
        keys,
        mean=F.avg(value),
        first_value=F.min_by(value, "date"),
        last_value=F.max_by(value, "date"),
    )
    by = (*keys, "freq")
    filled = ffill(periods, by, "mean", "px")
    return filled.withColumn("r", simple_return(F.col("px"), F.lag("px").over(by_time(*by))))


def return_statistics(returns: DataFrame, keys: Sequence[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Count, mean, median, std (in percent), skewness and excess kurtosis of ``r``."""
    r = F.col("r")
    return returns.groupBy(*keys).agg(
        F.count(r).alias("n_returns"),
        F.bround(F.avg(r * 100), 2).alias("mean"),
        F.bround(F.percentile(r * 100, F.lit(0.5)), 2).alias("median"),
        F.bround(F.stddev_samp(r * 100), 2).alias("std"),
        F.bround(unbiased_skewness(r), 2).alias("skew"),
        F.bround(unbiased_kurtosis(r), 2).alias("kurtosis"),
        *(c.alias(name) for name, c in (extra or {}).items()),
    )


def portfolio_summary(values: DataFrame, freqs: Sequence[str] = tuple(BINS)) -> DataFrame:
    """Return statistics per portfolio and frequency, all frequencies in one job."""
    origin, final = F.min_by("first_value", "n"), F.max_by("last_value", "n")
    overall = F.bround(simple_return(final, origin) * 100, 2)
    return return_statistics(period_returns(values, freqs), ("portfolio", "freq"), {"overall_return": overall})


def histogram(df: DataFrame, bins: Column | int, keys: Sequence[str], value: str = "r") -> DataFrame:
    """Equal-width histogram per group; the last bin is closed, empty bins are listed.

    ``bins`` may be a column of the grouping keys. A group with a single value
    gets the range ``value - 0.5 .. value + 0.5``.
    """
    bins = F.lit(bins) if isinstance(bins, int) else bins
    known = df.where(F.col(value).isNotNull())
    bounds = (
        known.groupBy(*keys)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        .withColumn("flat", F.col("lo") == F.col("hi"))
        .select(
            *keys,
            F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
            bins.cast("int").alias("n_bins"),
        )
    )
    slot = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n_bins"))
    counted = (
        known.join(bounds, list(keys))
        .groupBy(*keys, F.least(slot, F.col("n_bins") - 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    return (
        bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
        .join(counted, [*keys, "bin"], "left")
        .select(
            *keys,
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("lower"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce("frequency", F.lit(0)).cast("bigint").alias("frequency"),
        )
    )


def return_histogram(values: DataFrame, bins: Mapping[str, int] = BINS) -> DataFrame:
    """Return histogram per portfolio and frequency with that frequency's bins."""
    per_freq = F.coalesce(*(F.when(F.col("freq") == f, F.lit(n)) for f, n in bins.items()))
    return histogram(period_returns(values, list(bins)), per_freq, ("portfolio", "freq"))


def annual_sharpe(
    values: DataFrame, start: str | None = None, rfr: float = 0.0, samples_per_year: int = 252
) -> DataFrame:
    """Annual Sharpe ratio per portfolio: sqrt(samples) x mean / std of daily returns."""
    daily = daily_returns(values, ("portfolio",), "value")
    yearly = resample(daily, "annual", ("portfolio",), mean=F.avg("r"), std=F.stddev_samp("r"))
    excess = F.col("mean") - rfr / samples_per_year
    out = yearly.select(
        "portfolio",
        "date",
        (F.sqrt(F.lit(float(samples_per_year))) * F.try_divide(excess, F.col("std"))).alias("sharpe"),
    )
    return out if start is None else out.where(F.col("date") >= F.lit(start).cast("date"))


def return_comparison(values: DataFrame, start: str, portfolios: Sequence[str]) -> DataFrame:
    """Cumulative return in percent, one column per portfolio, shown from ``start``.

    Returns compound from the start of each series, not from ``start``. Dates on
    which some portfolio has no row are left out.
    """
    cum = cumulative_return(values, ("portfolio",), "value").select(
        "portfolio", "date", F.bround("Cum_Return", 2).alias("cum")
    )
    shown = cum.where((F.col("date") >= F.lit(start).cast("date")) & F.col("portfolio").isin(list(portfolios)))
    held = shown.groupBy("date").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == len(portfolios))
    return wide(shown.join(held, "date", "left_semi"), portfolios, "cum", "portfolio")


def asset_summary(returns: DataFrame) -> DataFrame:
    r = F.col("r")
    return return_statistics(returns, ("asset",), {"worst": F.min(r) * 100, "best": F.max(r) * 100})


def linear_trend(panel: DataFrame, value: str = "price") -> DataFrame:
    """Least-squares line of price on day number per asset."""
    y, x = F.col(value), F.col("n")
    return panel.groupBy("asset").agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(y).alias("n_prices"),
    )


def iqr_by_frequency(panel: DataFrame, freqs: Sequence[str] = ("monthly", "quarterly")) -> DataFrame:
    """Interquartile range of period returns per asset and frequency, in percent."""
    returns = period_returns(panel, freqs, ("asset",), "price")
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.75)))
    return returns.groupBy("asset", "freq").agg(
        ((F.element_at(q, 2) - F.element_at(q, 1)) * 100).alias("iqr"), F.count("r").alias("n_returns")
    )
