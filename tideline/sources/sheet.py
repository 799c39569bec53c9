"""Wide sheets of alternating date and price columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pair_schema(labels: list[str], parsed: bool = False) -> T.StructType:
    """Declared schema of a sheet: one date column and one price column per label."""
    date_type = T.DateType() if parsed else T.StringType()
    fields = []
    for k, label in enumerate(labels, start=1):
        fields += [T.StructField(f"date{k}", date_type), T.StructField(label, T.DoubleType())]
    return T.StructType(fields)


def read_pair_sheet(spark: SparkSession, path: str, labels: list[str], fmt: str = "csv") -> DataFrame:
    """Read a sheet with a declared schema, so no pass over the data infers types."""
    reader = spark.read.schema(pair_schema(labels))
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def unpivot_pairs(sheet: DataFrame, date_format: str | None = None) -> DataFrame:
    """Alternating (date, price) columns to long ``(asset, date, price)`` rows.

    Even positions hold dates, odd positions prices; the asset is named after
    its price column. Only column names are looked at on the driver. One narrow
    pass: every sheet row yields one row per pair, and the padding of the
    shorter pairs (no date and no price) is dropped on the way.
    """
    dates, labels = sheet.columns[0::2], sheet.columns[1::2]
    if len(dates) != len(labels):
        raise ValueError("a pair sheet needs an even number of columns")
    fmt = F.lit(date_format) if date_format else None
    pairs = [
        F.struct(
            F.lit(label).alias("asset"),
            F.try_to_timestamp(F.col(f"`{d}`").cast("string"), fmt).cast("date").alias("date"),
            F.col(f"`{label}`").cast("double").alias("price"),
        )
        for d, label in zip(dates, labels)
    ]
    return (
        sheet.select(F.inline(F.array(*pairs)))
        .where(F.col("date").isNotNull() | F.col("price").isNotNull())
        .withColumn("price", F.nanvl("price", F.lit(None).cast("double")))
    )
