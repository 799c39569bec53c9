"""Cleaning, calendar alignment and reshaping of price panels.

A panel has one row per asset and business day: ``(asset, date, n, price)``
with ``n`` the integer day number. A pair (asset, date) is unique, so the rows
of one asset are bounded by the length of the calendar; that is what makes
per-asset windows safe no matter how many raw observations an asset has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import day_number, is_business_day


def with_day(df: DataFrame) -> DataFrame:
    """Add the day number ``n`` unless the frame carries it already."""
    return df if "n" in df.columns else df.withColumn("n", day_number(F.col("date")))


def by_time(*keys: str) -> Window:
    """The one window every time-series operator uses, so that sorts are shared."""
    return Window.partitionBy(*keys).orderBy("n")


def business_calendar(observations: DataFrame) -> DataFrame:
    """Monday-to-Friday days from the first to the last observed date."""
    return (
        observations.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        .select(F.explode(F.sequence(F.unix_date("lo"), F.unix_date("hi"))).alias("n"))
        .where(is_business_day(F.col("n")))
        .select(F.date_from_unix_date("n").alias("date"))
    )


def clean_prices(observations: DataFrame, start: str, end: str, strict: bool = False) -> DataFrame:
    """Align raw ``(asset, date, price)`` observations to the business calendar.

    Observations without a price and off-calendar observations are dropped, and
    missing days become rows with a NULL price. An asset left without any
    observation keeps its (all NULL) rows. A repeated (asset, date) is an error, and
    with ``strict`` also a price on a business day outside the range.

    No asset x calendar join is made: each observation generates the days up to
    the next observation of its asset, so the panel costs one shuffle and
    leaves already distributed by asset.
    """
    lo, hi = F.unix_date(F.lit(start).cast("date")), F.unix_date(F.lit(end).cast("date"))
    price = F.nanvl(F.col("price").cast("double"), F.lit(None).cast("double"))
    day = F.unix_date("date")
    repeated = (F.col("copies") > 1) & F.col("date").isNotNull()
    complaint = F.concat(F.lit("duplicate observation of "), "asset", F.lit(" on "), F.col("date").cast("string"))
    outside = F.lit(strict) & (F.col("copies") > 0) & ~day.between(lo, hi) & is_business_day(day)
    late = F.concat(F.lit("observation outside the panel: "), "asset", F.lit(" on "), F.col("date").cast("string"))
    # Days without a usable price get a NULL day: they only mark that the asset exists.
    usable = (F.col("copies") > 0) & day.between(lo, hi) & is_business_day(day)
    once = (
        observations.select("asset", "date", price.alias("price"))
        .groupBy("asset", "date")
        .agg(F.max("price").alias("price"), F.count("price").alias("copies"))
        .select(
            "asset",
            F.when(repeated, F.raise_error(complaint).cast("int"))
            .when(outside, F.raise_error(late).cast("int"))
            .when(usable, day)
            .alias("obs"),
            "price",
        )
    )
    w = Window.partitionBy("asset").orderBy(F.col("obs").asc_nulls_first())
    first_obs = F.min("obs").over(Window.partitionBy("asset"))
    spans = (
        once.select(
            "asset",
            "obs",
            "price",
            F.row_number().over(w).alias("rank"),
            F.coalesce(F.when(F.col("obs").isNull(), first_obs).otherwise(F.lead("obs").over(w)) - 1, hi).alias("to"),
        )
        # Of several markers one is enough; it spans the days before the first price.
        .where(F.col("obs").isNotNull() | (F.col("rank") == 1))
        .withColumn("from", F.when(F.col("rank") == 1, lo).otherwise(F.col("obs")))
        .where(F.col("from") <= F.col("to"))
    )
    return (
        spans.select("asset", "obs", "price", F.explode(F.sequence("from", "to")).alias("n"))
        .where(is_business_day(F.col("n")))
        .select(
            "asset",
            F.date_from_unix_date("n").alias("date"),
            "n",
            F.when(F.col("n") == F.col("obs"), F.col("price")).alias("price"),
        )
    )


def ffill(df: DataFrame, keys: Sequence[str] = ("asset",), value: str = "price", out: str = "px") -> DataFrame:
    """Carry the last known value forward; leading NULLs stay NULL."""
    w = by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return with_day(df).withColumn(out, F.last(value, ignorenulls=True).over(w))


def asset_subset(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    return panel.where(F.col("asset").isin(list(assets)))


def between_years(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the inclusive year range, as a plain range so that files prune."""
    return panel.where(
        (F.col("date") >= F.make_date(F.lit(first), F.lit(1), F.lit(1)))
        & (F.col("date") < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))
    )


def named(key: str, names: Sequence[str]) -> Column:
    """The key, which has to be one of the names."""
    unknown = F.raise_error(F.concat(F.lit(f"{key} without a column: "), F.coalesce(key, F.lit("NULL"))))
    return F.when(F.col(key).isin(list(names)), F.col(key)).otherwise(unknown.cast("string"))


def wide(panel: DataFrame, assets: Sequence[str], value: str = "price", key: str = "asset") -> DataFrame:
    """Long to wide: one column per named asset; an asset that is not named is an error (see :func:`asset_subset`).

    The names are given by the caller, so no job runs to discover them.
    """
    panel = panel.withColumn(key, named(key, assets))
    return panel.groupBy("date").pivot(key, list(assets)).agg(F.first(value))


def tail(df: DataFrame, rows: int = 5) -> DataFrame:
    """The last rows by date (a top-k, not a full sort)."""
    return df.orderBy(F.col("date").desc()).limit(rows)


def complete_cases(panel: DataFrame, keys: Sequence[str] = ("date",), value: str = "price") -> DataFrame:
    """Rows of those dates on which no asset is missing.

    The panel has a row per asset and date, so a date is complete when it has
    as many values as rows. Counting pre-aggregates on the map side; Spark
    broadcasts the list of complete dates while its measured size allows that.
    """
    full = panel.groupBy(*keys).agg(F.count(value).alias("have"), F.count(F.lit(1)).alias("want"))
    dates = full.where(F.col("have") == F.col("want")).select(*keys)
    return panel.join(dates, list(keys), "left_semi")


def series_quality(observations: DataFrame, order: str = "seq", chunk: int = 1_000_000) -> DataFrame:
    """Per-asset audit of raw observations.

    Counts rows, missing prices, weekend dates, repeated dates and dates that
    step backwards in arrival order. Arrival order is checked per slice of
    ``chunk`` sequence numbers and then across slices, so no asset is ever
    sorted as a whole.
    """
    counts = observations.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("price").isNull()).alias("n_null"),
        F.count_if(~is_business_day(F.unix_date("date"))).alias("n_off_calendar"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    repeats = (
        observations.groupBy("asset", "date")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("asset")
        .agg(F.sum("extra").alias("n_duplicate"))
    )
    slice_no = F.floor(F.col(order) / chunk).alias("slice")
    inside = Window.partitionBy("asset", "slice").orderBy(order, "date")
    slices = (
        observations.select("asset", "date", order, slice_no)
        .withColumn("back", (F.col("date") < F.lag("date").over(inside)).cast("int"))
        .groupBy("asset", "slice")
        .agg(
            F.sum(F.coalesce("back", F.lit(0))).alias("back"),
            F.min(F.struct(order, "date"))["date"].alias("head"),
            F.max(F.struct(order, "date"))["date"].alias("foot"),
        )
    )
    across = Window.partitionBy("asset").orderBy("slice")
    steps = (
        slices.withColumn("cross", (F.col("head") < F.lag("foot").over(across)).cast("int"))
        .groupBy("asset")
        .agg(F.sum(F.col("back") + F.coalesce("cross", F.lit(0))).alias("n_backward"))
    )
    return (
        counts.join(repeats, "asset")
        .join(steps, "asset")
        .withColumn("is_monotonic", F.col("n_backward") == 0)
    )


def near_duplicates(correlations: DataFrame, at_least: float = 0.999) -> DataFrame:
    """Asset pairs that move together so closely that one may copy the other."""
    return correlations.where((F.col("i") < F.col("j")) & (F.col("corr") >= at_least))


def shifted(col: str, keys: Sequence[str], days: int) -> Column:
    """Value exactly ``days`` calendar days earlier; NULL if that day has no row."""
    return F.max(col).over(by_time(*keys).rangeBetween(-days, -days))
