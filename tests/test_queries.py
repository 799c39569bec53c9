import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tideline.plans import queries as registered

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the shipped tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF_DIR}/{f}'")
    return con


def test_every_sql_has_a_query():
    rows_only = set(registered.REGISTRY) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert rows_only == {"weights_max_sharpe", "weights_min_vol", "weights_by_rebalance", "efficient_frontier"}


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and len(first.columns) == 72
    assert first.count() == 17850


# The whole set is compared by tools/compare.py; these cover each module on the sparsest data.
@pytest.mark.parametrize(
    "name", ["unpivot_pairs", "series_quality", "rolling_std", "rolling_kurtosis", "cov_ledoit_wolf", "portfolio_summary", "mu_by_rebalance"]
)
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    expected = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    floats = [c for c in got.columns if got[c].dtype == "float64"]
    keys = [c for c in got.columns if c not in floats]
    got, expected = (df.sort_values(keys, ignore_index=True) for df in (got, expected))
    for c in keys:
        assert list(got[c]) == list(expected[c]), c
    for c in floats:
        # Sparse windows give exact fractions, whose last rounded digit may fall either way.
        np.testing.assert_allclose(got[c], expected[c].astype(float), atol=1.01e-4, err_msg=c)


def test_half_up_equals_round(spark):
    """The same doubles as round(), at ties, beyond them and where there is nothing to round."""
    from pyspark.sql import functions as F

    from tideline.functions.stats import half_up

    rng = np.random.default_rng(5)
    odd = [0.005, 0.015, 1.005, 2.675, -0.005, -0.004, -0.0, 0.125, 0.5, 1.5, 2.5, -2.5, 1e9, 123456789.125, 1e17, -1e300, 0.49999999999999994]
    odd += [float("nan"), float("inf"), float("-inf"), None, *(rng.normal(0, 1, 2000) * 10 ** rng.uniform(-4, 9, 2000)).tolist(), *(rng.integers(-9999, 9999, 2000) / 1000).tolist()]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    for digits in (0, 2, 4):
        for got, expected in df.select(half_up(F.col("x"), digits), F.round("x", digits)).collect():
            assert repr(got) == repr(expected)


def test_supplier_observations_of_odd_keys(spark, tmp_path):
    """Labels are those of the format for any key, and each key keeps its own."""
    from pyspark.sql import functions as F

    from tideline.sources.star import supplier_observations

    keys = [None, 0, 7, 99_999_999, 100_000_000, 2**62, -1, -12_345_678]
    lines = spark.createDataFrame([(k, 2.0, 10.005) for k in keys], "l_suppkey bigint, l_quantity double, l_extendedprice double")
    lines = lines.select("*", F.lit("2000-01-03").cast("timestamp_ntz").alias("l_shipdate"), F.lit(1).cast("bigint").alias("l_orderkey"), F.lit("F").alias("l_linestatus"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.asset, r.price) for r in supplier_observations(spark, str(tmp_path)).collect())
    labels = [r[0] for r in lines.select(F.format_string("S%08d", "l_suppkey")).collect()]
    cents = lines.select(F.round(F.col("l_extendedprice") * 100)).first()[0]
    assert got == sorted((x, cents / 200) for x in labels)
