"""Resampling to calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import period_end, period_number


def resample(
    df: DataFrame,
    freqs: Sequence[str] | str,
    keys: Sequence[str] = ("asset",),
    **aggregates: Column,
) -> DataFrame:
    """Aggregate each series to periods labelled by their last day.

    Several frequencies are computed in one job: ``freq`` becomes a grouping
    column. Empty periods inside a series come out as rows with NULL
    aggregates. Returns ``keys, freq, date, n, <aggregates>``; ``n`` numbers the
    periods.
    """
    freqs = [freqs] if isinstance(freqs, str) else list(freqs)
    tags = [F.struct(F.lit(f).alias("freq"), period_number(F.col("date"), f).alias("n")) for f in freqs]
    tagged = df.select("*", F.explode(F.array(*tags)).alias("_p")).drop("n").select("*", "_p.freq", "_p.n").drop("_p")
    grouped = tagged.groupBy(*keys, "freq", "n").agg(*(c.alias(name) for name, c in aggregates.items()))
    # Each period also generates the empty ones up to the next; daily rows have no empty periods.
    following = F.lead("n").over(Window.partitionBy(*keys, "freq").orderBy("n")) - 1
    to = F.when(F.col("freq") == "daily", F.col("n")).otherwise(F.coalesce(following, F.col("n")))
    filled = grouped.withColumn("_to", to).withColumn("_n", F.explode(F.sequence("n", "_to")))
    label = F.coalesce(*(F.when(F.col("freq") == f, period_end(F.col("_n"), f)) for f in freqs))
    return filled.select(
        *keys,
        "freq",
        label.alias("date"),
        F.col("_n").alias("n"),
        *(F.when(F.col("_n") == F.col("n"), F.col(name)).alias(name) for name in aggregates),
    )
