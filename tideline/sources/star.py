"""Price observations from the order/line-item star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.stats import half_up

# Fixed business-day range of the shipped tables and its ten market labels.
PANEL_START, PANEL_END = "1995-01-02", "2001-11-02"
MARKETS = [
    "AFRICA_F", "AFRICA_O", "AMERICA_F", "AMERICA_O", "ASIA_F",
    "ASIA_O", "EUROPE_F", "EUROPE_O", "MIDDLE EAST_F", "MIDDLE EAST_O",
]


# The columns the panel needs; a declared schema saves a job per table that only reads file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linestatus string, l_quantity double, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def average_price() -> Column:
    """Average price per unit; money is summed in whole cents, so the order of rows cannot matter."""
    cents = F.sum(half_up(F.col("l_extendedprice") * 100).cast("bigint"))
    return (cents / (F.sum("l_quantity") * 100)).alias("price")


def market_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average price per market: ``(asset, date, price, seq)``.

    A market is the region of the supplier x the line status; ``seq`` is the
    smallest order key of the day, standing for arrival order.

    The joins are left-deep so that each dimension is judged by its own measured
    size: Spark broadcasts it while it is small and sort-merges it beyond that,
    with AQE splitting a hot supplier. Region names are only looked up for the
    aggregated rows. Nothing is broadcast by hint.
    """
    daily = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", "l_linestatus", F.col("l_shipdate").cast("date").alias("date"))
        .agg(average_price(), F.min("l_orderkey").alias("seq"))
    )
    return daily.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("_", "r_name", "l_linestatus").alias("asset"), "date", "price", "seq"
    )


def supplier_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily average price per supplier: a wide, sparse panel without any join."""
    key = F.col("l_suppkey")
    # What the format gives, at a fraction of its cost, for keys of up to eight digits.
    plain = F.concat(F.lit("S"), F.lpad(key.cast("string"), 8, "0"))
    label = F.when(key.between(0, 99_999_999), plain).otherwise(F.format_string("S%08d", key))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            label.alias("asset"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
        .agg(average_price())
    )
