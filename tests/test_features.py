import numpy as np
import pandas as pd
import pytest

from conftest import same, to_wide
from tideline.operators import returns, rolling


@pytest.fixture(scope="module")
def features(panel_df):
    return rolling.extract_features(panel_df).cache()


def pct(price, freq=None):
    return price.ffill().pct_change(freq=freq, fill_method=None)


def flat_aware(frame, kind):
    """Shape of a rolling frame, absent where all its values are equal."""
    moment = frame.skew() if kind == "Skew" else frame.kurt()
    return moment.where(frame.max() != frame.min())


def test_there_are_69_features(features):
    assert len(rolling.feature_columns()) == 69 and features.columns == ["asset", "date", "price", *rolling.feature_columns()]


@pytest.mark.parametrize("trading_days", [252, 360])
def test_lagged_returns(panel_df, trading_days):
    price = to_wide(panel_df, "price")
    lags = returns.horizons(trading_days)
    got = returns.lagged_returns(panel_df, lags)
    for h, k in lags.items():
        padded = price.ffill()
        before = padded.shift(freq=f"{k}D").reindex(padded.index)
        same(to_wide(got, f"Return_{h}"), (padded / before - 1) * 100)


def test_daily_cumulative_and_multi_period_returns(panel_df, returns_df):
    r = pct(to_wide(panel_df, "price"))
    same(to_wide(returns_df, "r"), r)
    same(to_wide(returns.cumulative_return(panel_df), "Cum_Return"), ((1 + r).cumprod() - 1) * 100)
    total = {row.asset: row.total_return for row in returns.multi_period_return(returns_df).collect()}
    same([total[a] for a in r.columns], (1 + r).prod() - 1)


@pytest.mark.parametrize("h", list(returns.HORIZON_FRACTIONS))
def test_rolling_features_match_pandas(features, h):
    x = to_wide(features, f"Return_{h}")
    days = returns.horizons()[h]
    frame = x.rolling(f"{days}D")
    same(to_wide(features, f"SMA_{h}_Return"), frame.mean(), 1e-7)
    std = x.rolling(f"{756 if h == '5yr' else days}D")
    same(to_wide(features, f"STD_{h}_Return"), std.std().where(std.max() != std.min(), std.std() * 0), 1e-6)
    for p in (10, 50, 90):
        same(to_wide(features, f"Quantile_{h}_{p}"), frame.quantile(p / 100))
    same(to_wide(features, f"IQR_{h}"), frame.quantile(0.75) - frame.quantile(0.25))
    same(to_wide(features, f"Range_{h}"), frame.max() - frame.min())
    for family in ("Skew", "Kurtosis"):
        # Loose: the incremental figures of pandas lose digits after large values.
        same(to_wide(features, f"{family}_{h}"), flat_aware(frame, family), 1e-4)


def test_expanding_features_match_pandas(features, returns_df):
    so_far = to_wide(returns_df, "r").expanding()
    same(to_wide(features, "Cum_STD"), so_far.std())
    for p in (10, 50, 90):
        same(to_wide(features, f"Cum_Quantile_{p}"), so_far.quantile(p / 100))
    same(to_wide(features, "Cum_IQR"), so_far.quantile(0.75) - so_far.quantile(0.25))
    same(to_wide(features, "Cum_Range"), so_far.max() - so_far.min())
    same(to_wide(features, "Cum_Skew"), so_far.skew(), 1e-6)
    same(to_wide(features, "Cum_Kurtosis"), so_far.kurt(), 1e-6)


def test_slices_change_nothing(panel_df):
    lags = {"3month": 63, "9month": 189}
    df = returns.lagged_returns(panel_df, lags)
    means, shapes = rolling.return_mean_frames(lags), rolling.return_shape_frames(lags)
    for step, frames, columns in (
        (rolling.rolling_mean, means, ["SMA_3month_Return", "SMA_9month_Return"]),
        (rolling.shape_statistics, shapes, ["STD_9month_Return", "Quantile_9month_50", "Range_3month", "Kurtosis_9month"]),
    ):
        whole = step(df, frames)
        sliced = rolling.in_slices(df, 189, 250, lambda d, keys, s=step, f=frames: s(d, f, keys))
        assert sliced.count() == whole.count()
        for c in columns:
            same(to_wide(sliced, c), to_wide(whole, c), 1e-6)


def test_frame_edges_and_small_counts(make):
    # A value exactly k days back has left the frame (t - k, t].
    from tideline.operators.panel import with_day

    df = with_day(make([("x", "2021-01-04", 10.0), ("x", "2021-01-08", 1.0), ("x", "2021-01-11", 2.0), ("x", "2021-01-12", 4.0),
                        ("x", "2021-01-13", 8.0)]))
    out = rolling.rolling_mean(df, [rolling.MeanFrame("price", 7, "m")])
    out = rolling.shape_statistics(out, [rolling.ShapeFrame("price", 7, {"s": ("std",), "sk": ("skew",), "ku": ("kurt",)})])
    rows = out.orderBy("date").collect()
    assert [round(r.m, 6) for r in rows] == [10.0, 5.5, 1.5, round(7 / 3, 6), 3.75]
    assert rows[0].s is None and rows[1].s == pytest.approx(np.std([10, 1], ddof=1))
    assert [r.sk is None for r in rows] == [True, True, True, False, False]
    assert [r.ku is None for r in rows] == [True, True, True, True, False]
    assert rows[4].ku == pytest.approx(pd.Series([1.0, 2.0, 4.0, 8.0]).kurt())


def test_constant_prices_have_no_shape(make):
    from tideline.operators.panel import with_day

    days = pd.bdate_range("2021-01-04", periods=30)
    values = [1e6, 3.3] + [0.1] * 28
    df = with_day(make([("x", str(d.date()), v) for d, v in zip(days, values)]))
    out = rolling.rolling_mean(df, [rolling.MeanFrame("price", 14, "m")])
    out = rolling.shape_statistics(out, [rolling.ShapeFrame("price", 14, {"s": ("std",), "sk": ("skew",), "ku": ("kurt",)})])
    last = out.orderBy("date").collect()[-1]
    assert last.s == 0.0 and last.sk is None and last.ku is None and last.m == pytest.approx(0.1)


def test_small_moves_after_a_large_value_keep_their_digits(make):
    from tideline.operators.panel import with_day

    rng = np.random.default_rng(3)
    days = pd.bdate_range("2021-01-04", periods=60)
    values = np.concatenate([[5e7, -3e7], 0.1 + 1e-3 * rng.normal(size=58)])
    df = with_day(make([("x", str(d.date()), float(v)) for d, v in zip(days, values)]))
    frame = rolling.ShapeFrame("price", 28, {"s": ("std",), "sk": ("skew",), "ku": ("kurt",)})
    last = rolling.shape_statistics(df, [frame]).orderBy("date").collect()[-1]
    window = pd.Series(values[-20:])
    assert last.s == pytest.approx(window.std(), rel=1e-9)
    assert last.sk == pytest.approx(window.skew(), rel=1e-9) and last.ku == pytest.approx(window.kurt(), rel=1e-9)


def test_a_large_value_leaves_no_trace(make):
    from tideline.operators.panel import with_day

    rng = np.random.default_rng(4)
    days = pd.bdate_range("2021-01-04", periods=90)
    values = 0.1 + 1e-3 * rng.normal(size=90)
    values[17], values[40] = 1e15, np.nan
    rows = [("x", str(d.date()), None if np.isnan(v) else float(v)) for d, v in zip(days, values) if d.day != 9]
    outputs = {"m": ("mean",), "s": ("std",), "sk": ("skew",), "ku": ("kurt",), "r": ("spread", 0, 1), "q": ("quantile", 0.3)}
    got = rolling.shape_statistics(with_day(make(rows)), [rolling.ShapeFrame("price", 16, outputs)], slice_days=20).toPandas()
    got = got.set_index(pd.to_datetime(got["date"])).sort_index()
    x = got["price"].astype(float)
    for day in got.index:
        frame = x[(x.index > day - pd.Timedelta(days=16)) & (x.index <= day)]
        now = got.loc[day]
        expected = {"m": frame.mean(), "s": frame.std(), "r": frame.max() - frame.min(), "q": frame.quantile(0.3)}
        if frame.max() < 1e10:
            expected |= {"sk": frame.skew() if frame.count() > 2 else np.nan, "ku": frame.kurt() if frame.count() > 3 else np.nan}
        for name, value in expected.items():
            assert float(now[name]) == pytest.approx(value, rel=1e-9, nan_ok=True), (day, name)


@pytest.mark.parametrize("run", [1, 3, 64])
def test_expanding_quantiles_by_runs(spark, run):
    rng = np.random.default_rng(run)
    values = [None if rng.random() < 0.2 else float(rng.integers(0, 30)) ** 3 for _ in range(300)]
    rows = [(a, k, v) for a in ("a", "b") for k, v in enumerate(values if a == "a" else sorted(values, key=lambda v: -(v or 0)))]
    rows += [("c", k, None) for k in range(5)]
    df = spark.createDataFrame(rows, "asset string, n int, r double").repartition(4)
    got = rolling.expanding_quantiles(df, run=run).toPandas().sort_values(["asset", "n"])
    assert len(got) == len(rows)
    for _, own in got.groupby("asset"):
        so_far = own["r"].astype(float).expanding()
        for name, p in (("Cum_Quantile_10", 0.1), ("Cum_Quantile_50", 0.5), ("Cum_Quantile_90", 0.9)):
            same(own[name], so_far.quantile(p))
        same(own["Cum_IQR"], so_far.quantile(0.75) - so_far.quantile(0.25))


def test_features_have_no_python_node(panel_df):
    plan = rolling.extract_features(panel_df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("InPandas", "InArrow", "Python"))
