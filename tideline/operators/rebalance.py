"""Periodic rebalancing: dates, weight changes and the return of changing weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import is_business_day, period_number
from tideline.operators.panel import by_time, with_day


def rebalance_dates(panel: DataFrame, freq: str = "quarterly") -> DataFrame:
    """Last panel day of every period: ``(period, rebalance_date)``."""
    return panel.groupBy(period_number(F.col("date"), freq).alias("period")).agg(
        F.max("date").alias("rebalance_date")
    )


def dated(estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """Replace the period number of per-period estimates by its rebalance date."""
    return estimates.join(dates, "period").drop("period")


def _validity(weights: DataFrame) -> DataFrame:
    """Per portfolio and rebalance date the date of the next rebalance."""
    dates = weights.select("portfolio", "rebalance_date").distinct()
    follow = F.lead("rebalance_date").over(Window.partitionBy("portfolio").orderBy("rebalance_date"))
    return dates.withColumn("next_date", follow)


def weight_changes(weights: DataFrame) -> DataFrame:
    """Old weight, new weight and difference per portfolio, rebalance date and asset.

    An asset without a row at a date has weight 0 there, so sparse weight
    tables work; each weight is carried to the next date of its portfolio.
    """
    moved = weights.join(_validity(weights), ["portfolio", "rebalance_date"])
    new = F.struct(
        F.col("rebalance_date").alias("at"), F.lit(0.0).alias("old_weight"), F.col("weight").alias("new_weight")
    )
    old = F.struct(
        F.col("next_date").alias("at"), F.col("weight").alias("old_weight"), F.lit(0.0).alias("new_weight")
    )
    return (
        moved.select("portfolio", "asset", F.inline(F.array(new, old)))
        .where(F.col("at").isNotNull())
        .groupBy("portfolio", F.col("at").alias("rebalance_date"), "asset")
        .agg(F.sum("old_weight").alias("old_weight"), F.sum("new_weight").alias("new_weight"))
        .withColumn("delta", F.col("new_weight") - F.col("old_weight"))
    )


def turnover(weights: DataFrame) -> DataFrame:
    """Sum of absolute weight changes per portfolio and rebalance date."""
    return weight_changes(weights).groupBy("portfolio", "rebalance_date").agg(
        F.sum(F.abs("delta")).alias("turnover"), F.count_if(F.col("delta") != 0).alias("n_changed")
    )


def rebalanced_return(returns: DataFrame, weights: DataFrame, end: str) -> DataFrame:
    """Daily and cumulative return of a portfolio whose weights change.

    New weights apply from the business day after their rebalance date up to
    and including the next one, so no return is earned with weights that were
    not known yet. Holdings are unrolled to days and equi-joined with the
    returns on (asset, day); there is no interval join. On a day on which a held
    asset has no return the portfolio's is NULL, and so is the cumulative return from
    then on.
    """
    last = F.unix_date(F.coalesce("next_date", F.lit(end).cast("date")))
    first = F.unix_date("rebalance_date") + 1
    holdings = (
        weights.where(F.col("weight") != 0)
        .join(_validity(weights), ["portfolio", "rebalance_date"])
        .withColumns({"first": first, "last": last})
        .where(F.col("first") <= F.col("last"))
        .select("portfolio", "asset", "weight", F.explode(F.sequence("first", "last")).alias("n"))
        .where(is_business_day(F.col("n")))
    )
    daily = (
        holdings.join(with_day(returns).select("asset", "n", "r"), ["asset", "n"], "left")
        .groupBy("portfolio", "n")
        .agg(F.when(F.count("r") == F.count("*"), F.sum(F.col("weight") * F.col("r"))).alias("r"))
    )
    so_far = by_time("portfolio").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "portfolio",
        F.date_from_unix_date("n").alias("date"),
        "r",
        F.when(
            F.count("r").over(so_far) == F.count("*").over(so_far), (F.product(F.col("r") + 1).over(so_far) - 1) * 100
        ).alias("cum_return"),
    )
