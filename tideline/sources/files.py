"""Weight files and per-asset series files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHT_SCHEMA = "asset string, weight double"


def read_weights(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Header-less ``asset,weight`` files to long ``(portfolio, asset, weight)``."""
    frames = [
        spark.read.schema(WEIGHT_SCHEMA).csv(path).select(F.lit(name).alias("portfolio"), "asset", "weight")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def write_weights(weights: DataFrame, path: str) -> None:
    """One header-less ``asset,weight`` folder per portfolio."""
    weights.select("portfolio", "asset", "weight").write.mode("overwrite").partitionBy("portfolio").option(
        "header", False
    ).csv(path)


def write_series(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per asset.

    Panels leave the operators already distributed by asset, so each asset is
    written by a single task and no shuffle is added here.
    """
    panel.write.mode("overwrite").partitionBy("asset").format(fmt).save(path)


def read_series(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read what :func:`write_series` wrote; an asset filter prunes folders."""
    return spark.read.format(fmt).load(path)
