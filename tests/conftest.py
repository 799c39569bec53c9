import os
import sys
from datetime import date

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tideline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def observations(spark):
    """Random walks of five assets over 2015-2019 with holes, a late start and a frozen stretch."""
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2015-01-01", "2019-12-31")
    rows = []
    for k in range(5):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01 + 0.004 * k, len(days))))
        if k == 3:
            price[300:700] = price[300]
        for at, (d, p) in enumerate(zip(days, price)):
            if (k == 1 and at < 120) or rng.random() < 0.05 * k:
                continue
            rows.append((f"a{k}", d.date(), float(p)))
    return spark.createDataFrame(rows, "asset string, date date, price double").cache()


@pytest.fixture(scope="session")
def panel_df(observations):
    from tideline.operators.panel import clean_prices

    return clean_prices(observations, "2015-01-01", "2019-12-31").cache()


@pytest.fixture(scope="session")
def returns_df(panel_df):
    from tideline.operators.returns import daily_returns

    return daily_returns(panel_df).cache()


@pytest.fixture
def make(spark):
    """Small panels from ``(asset, 'YYYY-MM-DD', price)`` rows."""

    def build(rows):
        typed = [(a, date.fromisoformat(d) if d else None, p) for a, d, p in rows]
        return spark.createDataFrame(typed, "asset string, date date, price double")

    return build


def to_wide(df, value):
    pdf = df.select("asset", "date", value).toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    return pdf.pivot(index="date", columns="asset", values=value).sort_index().astype(float)


def same(got, expected, tolerance=1e-8):
    """Equal NULL positions and values within a relative tolerance."""
    got, expected = np.asarray(got, dtype=float), np.asarray(expected, dtype=float)
    assert got.shape == expected.shape
    np.testing.assert_array_equal(np.isnan(got), np.isnan(expected))
    np.testing.assert_allclose(got, expected, rtol=tolerance, atol=tolerance, equal_nan=True)
