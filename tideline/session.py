"""Session settings used by the tests and the benchmark.

On a cluster the session comes from the submitter; the operators never change
its settings.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A quiet local session for tests and benchmarks (no web page)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The partition count is already the core count; merging small partitions would idle cores.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether lineage can be cut in a folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    in local mode, where it is unset in tests, a scratch folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.startswith("local"):
            shared = tempfile.mkdtemp(prefix="run-")
        if shared is not None:
            context.setCheckpointDir(shared)
    return context.getCheckpointDir() is not None


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that is used several times; without a shared folder leave it as it is."""
    return df.checkpoint() if has_checkpoint_dir(df.sparkSession) else df
