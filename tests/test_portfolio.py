import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from conftest import to_wide
from tideline.operators import estimators, measure, optimize, panel, portfolio, rebalance


@pytest.fixture(scope="module")
def weights(spark):
    rows = [("p", f"a{k}", w) for k, w in enumerate([0.1, 0.2, 0.3, 0.4, 0.0])]
    rows += [("q", f"a{k}", 0.2) for k in range(5)]
    return spark.createDataFrame(rows, "portfolio string, asset string, weight double")


@pytest.fixture(scope="module")
def values(panel_df, weights):
    return portfolio.portfolio_value(panel_df, weights).cache()


def expected_value(panel_df, name):
    price = to_wide(panel_df, "price").dropna()
    w = {"p": [0.1, 0.2, 0.3, 0.4, 0.0], "q": [0.2] * 5}[name]
    return (price * w).sum(axis=1)


def random_problem(spark, size, seed, groups=1):
    rng = np.random.default_rng(seed)
    mu_rows, cov_rows, problems = [], [], []
    for g in range(groups):
        factors = rng.normal(size=(size, max(3, size // 4)))
        v = factors @ factors.T / factors.shape[1] + np.diag(rng.uniform(0.05, 0.5, size))
        mu = rng.uniform(0.03, 0.15, size)
        names = [f"s{k:03d}" for k in range(size)]
        mu_rows += [(g, a, float(m)) for a, m in zip(names, mu)]
        cov_rows += [(g, names[i], names[j], float(v[i, j])) for i in range(size) for j in range(size)]
        problems.append((mu, v))
    return (
        spark.createDataFrame(mu_rows, "g int, asset string, mu double"),
        spark.createDataFrame(cov_rows, "g int, i string, j string, cov double"),
        problems,
    )


def test_published_weight_tables(spark):
    from tideline.plans.queries import all_weights, published_weights

    table = portfolio.weights_table(published_weights(spark)).toPandas()
    assert len(table) == 10
    assert table["max_sharpe"].sum() == pytest.approx(0.99999) and table["min_vol"].sum() == pytest.approx(1.00001)
    equal = all_weights(spark).where("portfolio = 'equal_wt'").toPandas()
    assert len(equal) == 10 and (equal["weight"] == 0.1).all()


def test_clean_weights_round_half_even_and_cut_off(spark):
    df = spark.createDataFrame([(0.00009,), (-0.00009,), (0.0001,), (0.125, ), (0.000125,), (0.333333333,)], "weight double")
    assert [r.weight for r in portfolio.clean_weights(df).collect()] == [0.0, 0.0, 0.0001, 0.125, 0.00012, 0.33333]


def test_portfolio_value_uses_complete_days_only(panel_df, values):
    for name in ("p", "q"):
        got = values.where(f"portfolio = '{name}'").toPandas().set_index("date")["value"].sort_index()
        expected = expected_value(panel_df, name)
        assert list(pd.to_datetime(got.index)) == list(expected.index)
        np.testing.assert_allclose(got, expected, rtol=1e-12)


def test_performance(spark, weights, returns_df):
    mu = estimators.ewm_mean_return(returns_df)
    cov = estimators.ledoit_wolf_cov(returns_df, n_blocks=1)
    m = mu.toPandas().set_index("asset")["mu"].sort_index().to_numpy()
    v = cov.toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
    for row in portfolio.performance(weights, mu, cov).collect():
        w = np.array({"p": [0.1, 0.2, 0.3, 0.4, 0.0], "q": [0.2] * 5}[row.portfolio])
        assert row.expected_return == pytest.approx(w @ m)
        assert row.volatility == pytest.approx(np.sqrt(w @ v @ w))
        assert row.sharpe == pytest.approx((w @ m - 0.02) / np.sqrt(w @ v @ w))


def optimality_gap(w, mu, v, b):
    """Largest violation of the optimality conditions of the scaled problem."""
    scale = (w @ b) / (w @ v @ w)
    slope = b - v @ (w * scale)
    return max(np.abs(slope[w > 1e-9]).max(), slope.max()) / np.abs(b).max()


@pytest.mark.parametrize("size", [2, 7, 30])
def test_optimal_weights_meet_the_optimality_conditions(spark, size):
    mu, cov, problems = random_problem(spark, size, size, groups=3)
    out = optimize.solve_weights(mu, cov, ("g",)).toPandas()
    assert len(out) == 3 * 2 * size and (out["status"] == "optimal").all()
    for (g, name), part in out.groupby(["g", "portfolio"]):
        w = part.sort_values("asset")["weight"].to_numpy()
        m, v = problems[g]
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        assert optimality_gap(w, m, v, np.ones(size) if name == "min_vol" else m - 0.02) < 1e-6


def test_identical_assets_and_hopeless_universes(spark):
    mu = spark.createDataFrame([("u", a, 0.1) for a in "xyz"] + [("v", a, 0.01) for a in "xy"], "g string, asset string, mu double")
    cov = spark.createDataFrame(
        [("u", i, j, 1.0 if {i, j} <= {"x", "y"} else (2.0 if i == j else 0.0)) for i in "xyz" for j in "xyz"]
        + [("v", i, j, 1.0 if i == j else 0.0) for i in "xy" for j in "xy"],
        "g string, i string, j string, cov double",
    )
    out = optimize.solve_weights(mu, cov, ("g",)).toPandas().set_index(["g", "portfolio", "asset"])
    low = out.loc["u", "min_vol"]["weight"]
    assert low["x"] + low["y"] == pytest.approx(2 / 3, abs=1e-6) and low["z"] == pytest.approx(1 / 3, abs=1e-6)
    hopeless = out.loc["v", "max_sharpe"]
    assert hopeless["weight"].isna().all() and set(hopeless["status"]) == {"no_excess_return"}


def test_frontier_is_efficient(spark):
    mu, cov, problems = random_problem(spark, 6, 5)
    points = optimize.solve_weights(mu, cov, ("g",), ("frontier",), points=12)
    scored = portfolio.performance(points, mu, cov, ("g",)).orderBy("portfolio").toPandas()
    assert len(scored) == 12
    assert (np.diff(scored["expected_return"]) >= -1e-9).all() and (np.diff(scored["volatility"]) >= -1e-9).all()
    assert scored["expected_return"].iloc[-1] <= problems[0][0].max() + 1e-9


@pytest.mark.parametrize("objective", optimize.OBJECTIVES)
def test_large_universes_give_the_same_weights(spark, objective):
    mu, cov, _ = random_problem(spark, 40, 11, groups=2)
    dense = optimize.solve_weights(mu, cov, ("g",), (objective,)).toPandas()
    large = optimize.solve_large(mu, cov, ("g",), objective, start=4, grow=3).toPandas()
    merged = dense.merge(large, on=["g", "portfolio", "asset"], suffixes=("_d", "_l"))
    assert len(merged) == len(dense) == len(large)
    np.testing.assert_allclose(merged["weight_d"], merged["weight_l"], atol=1e-6)
    with pytest.raises(PythonException, match="solve_large"):
        optimize.solve_weights(mu, cov, ("g",), limit=10).collect()


def test_large_universes_without_a_solution_say_so(spark):
    mu = spark.createDataFrame([("v", a, 0.01) for a in "abcd"], "g string, asset string, mu double")
    cov = spark.createDataFrame(
        [("v", i, j, 1.0 if i == j else 0.0) for i in "abcd" for j in "abcd"], "g string, i string, j string, cov double"
    )
    out = optimize.solve_large(mu, cov, ("g",), "max_sharpe", start=2).toPandas()
    assert sorted(out["asset"]) == list("abcd")
    assert out["weight"].isna().all() and set(out["status"]) == {"no_excess_return"}


def test_candidates_never_beat_the_optimum(spark):
    mu, cov, problems = random_problem(spark, 6, 3)
    scored = portfolio.candidates(mu, cov, ("g",))
    assert scored.count() == 6 + 15 * 19
    best = {r.portfolio: r for r in portfolio.best_candidates(scored, ("g",)).collect()}
    optimum = portfolio.performance(optimize.solve_weights(mu, cov, ("g",)), mu, cov, ("g",)).toPandas().set_index("portfolio")
    assert best["max_sharpe"].sharpe <= optimum.loc["max_sharpe", "sharpe"] + 1e-9
    assert best["min_vol"].volatility >= optimum.loc["min_vol", "volatility"] - 1e-9
    table = scored.toPandas()
    assert best["max_sharpe"].sharpe == table["sharpe"].max() and best["min_vol"].volatility == table["volatility"].min()
    points = portfolio.frontier_points(scored, ("g",)).toPandas()
    lo, hi = table["volatility"].min(), table["volatility"].max()
    table["bucket"] = np.minimum(np.floor((table["volatility"] - lo) / (hi - lo) * 20), 19).astype(int)
    expected = table.groupby("bucket")["expected_return"].max()
    np.testing.assert_allclose(points.set_index("bucket")["expected_return"].sort_index(), expected)
    legs = portfolio.candidate_weights(portfolio.best_candidates(scored, ("g",)), ("g",))
    assert all(r.total == pytest.approx(1) for r in legs.groupBy("portfolio").agg(F.sum("weight").alias("total")).collect())


RULES = {"daily": None, "monthly": "ME", "quarterly": "QE", "annual": "YE"}


def period_returns(panel_df, name, freq):
    series = expected_value(panel_df, name)
    series = series if RULES[freq] is None else series.resample(RULES[freq]).mean()
    return series.ffill().pct_change(fill_method=None)


def test_summary_and_histogram(panel_df, values):
    summary = measure.portfolio_summary(values).toPandas().set_index(["portfolio", "freq"])
    bars = measure.return_histogram(values).toPandas()
    for name in ("p", "q"):
        series = expected_value(panel_df, name)
        for freq in RULES:
            r, row = period_returns(panel_df, name, freq), summary.loc[(name, freq)]
            assert row["n_returns"] == r.count()
            assert row["overall_return"] == pytest.approx((series.iloc[-1] / series.iloc[0] - 1) * 100, abs=0.00501)
            for stat, expected in (
                ("mean", r.mean() * 100), ("median", r.median() * 100), ("std", r.std() * 100), ("skew", r.skew()), ("kurtosis", r.kurt()),
            ):
                if not np.isnan(expected):
                    assert row[stat] == pytest.approx(expected, abs=0.00501)
            part = bars[(bars["portfolio"] == name) & (bars["freq"] == freq)].sort_values("bin")
            counts, edges = np.histogram(r.dropna(), bins=measure.BINS[freq])
            assert part["frequency"].sum() == r.count() and len(part) == len(counts)
            np.testing.assert_allclose(part["lower"], edges[:-1], atol=1e-12)
            assert list(part["frequency"]) == list(counts)


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 4.0)] + [("b", 3.0)], "k string, r double")
    rows = measure.histogram(df, 4, ("k",)).orderBy("k", "bin").collect()
    assert [r.frequency for r in rows] == [1, 1, 1, 1, 0, 0, 1, 0]
    assert rows[4].lower == 2.5 and rows[7].upper == 3.5


def test_annual_sharpe_and_return_comparison(panel_df, values):
    sharpe = measure.annual_sharpe(values).toPandas()
    compared = measure.return_comparison(values, "2017-01-01", ["p", "q"]).toPandas().set_index("date").sort_index()
    for name in ("p", "q"):
        r = expected_value(panel_df, name).pct_change()
        expected = np.sqrt(252) * r.resample("YE").mean() / r.resample("YE").std()
        got = sharpe[sharpe["portfolio"] == name].set_index("date")["sharpe"].sort_index()
        np.testing.assert_allclose(got, expected)
        cum = ((1 + r).cumprod() - 1).mul(100).loc["2017":]
        assert len(cum) == len(compared)
        np.testing.assert_allclose(compared[name], cum, atol=0.00501)
    assert measure.annual_sharpe(values, "2018-01-01").count() == 4


def test_asset_level_statistics(panel_df, returns_df):
    wide = to_wide(returns_df, "r")
    price = to_wide(panel_df, "price")
    summary = measure.asset_summary(returns_df).toPandas().set_index("asset").sort_index()
    np.testing.assert_allclose(summary["median"], wide.median() * 100, atol=0.00501)
    np.testing.assert_allclose(summary["best"], wide.max() * 100)
    trend = measure.linear_trend(panel_df).toPandas().set_index("asset").sort_index()
    days = (price.index - pd.Timestamp("1970-01-01")).days.to_numpy()
    for asset in price:
        known = price[asset].notna().to_numpy()
        slope, intercept = np.polyfit(days[known] - 16000, price[asset][known], 1)
        assert trend.loc[asset, "slope"] == pytest.approx(slope, rel=1e-6)
        assert trend.loc[asset, "intercept"] == pytest.approx(intercept - slope * 16000, rel=1e-6)
    iqr = measure.iqr_by_frequency(panel_df).toPandas().set_index(["asset", "freq"])["iqr"]
    for asset in price:
        for freq in ("monthly", "quarterly"):
            series = price[asset].dropna().resample(RULES[freq]).mean().ffill().pct_change(fill_method=None)
            assert iqr[asset, freq] == pytest.approx((series.quantile(0.75) - series.quantile(0.25)) * 100)


def test_rebalancing(spark, panel_df, returns_df):
    dates = rebalance.rebalance_dates(panel_df).orderBy("period").toPandas()
    quarter_ends = pd.Series(1, index=to_wide(panel_df, "price").index).groupby(lambda d: (d.year, d.quarter)).apply(lambda s: s.index[-1])
    assert list(pd.to_datetime(dates["rebalance_date"])) == list(quarter_ends)
    d = [dates["rebalance_date"][k] for k in (8, 9, 10)]
    rows = [("p", d[0], "a0", 1.0), ("p", d[1], "a0", 0.25), ("p", d[1], "a2", 0.75), ("p", d[2], "a2", 1.0), ("q", d[1], "a4", 1.0)]
    held = spark.createDataFrame(rows, "portfolio string, rebalance_date date, asset string, weight double")
    changes = {(r.portfolio, r.rebalance_date, r.asset): r.delta for r in rebalance.weight_changes(held).collect()}
    assert changes == {
        ("p", d[0], "a0"): 1.0, ("p", d[1], "a0"): -0.75, ("p", d[1], "a2"): 0.75,
        ("p", d[2], "a0"): -0.25, ("p", d[2], "a2"): 0.25, ("q", d[1], "a4"): 1.0,
    }
    turned = {(r.portfolio, r.rebalance_date): r.turnover for r in rebalance.turnover(held).collect()}
    assert turned == {("p", d[0]): 1.0, ("p", d[1]): 1.5, ("p", d[2]): 0.5, ("q", d[1]): 1.0}

    got = rebalance.rebalanced_return(returns_df, held, "2019-12-31").where("portfolio = 'p'").toPandas()
    got = got.assign(date=pd.to_datetime(got["date"])).set_index("date").sort_index()
    wide, cut = to_wide(returns_df, "r"), pd.to_datetime(pd.Series(d))
    expected = pd.concat([
        wide["a0"][(wide.index > cut[0]) & (wide.index <= cut[1])],
        (0.25 * wide["a0"] + 0.75 * wide["a2"])[(wide.index > cut[1]) & (wide.index <= cut[2])],
        wide["a2"][wide.index > cut[2]],
    ])
    assert list(got.index) == list(expected.index)
    np.testing.assert_allclose(got["r"], expected, atol=1e-12)
    np.testing.assert_allclose(got["cum_return"], ((1 + expected).cumprod() - 1) * 100, rtol=1e-9, atol=1e-9)


def test_near_duplicates(spark):
    corr = spark.createDataFrame([("x", "y", 0.9999), ("y", "x", 0.9999), ("x", "x", 1.0), ("x", "z", 0.5)], "i string, j string, corr double")
    assert [(r.i, r.j) for r in panel.near_duplicates(corr).collect()] == [("x", "y")]


def test_unknown_holding_is_not_lost(spark, make):
    from tideline.operators.portfolio import performance, portfolio_value

    panel = make([("a", "2020-01-02", 10.0), ("b", "2020-01-02", 4.0)])
    weights = spark.createDataFrame(
        [("known", "a", 0.5), ("known", "b", 0.5), ("unknown", "a", 0.5), ("unknown", "zz", 0.5)],
        "portfolio string, asset string, weight double",
    )
    assert [(r.portfolio, r.value) for r in portfolio_value(panel, weights).collect()] == [("known", 7.0)]
    mu = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "asset string, mu double")
    cov = spark.createDataFrame(
        [("a", "a", 0.04), ("a", "b", 0.0), ("b", "a", 0.0), ("b", "b", 0.04)], "i string, j string, cov double"
    )
    got = {r.portfolio: (r.expected_return, r.volatility) for r in performance(weights, mu, cov).collect()}
    assert got["unknown"] == (None, None)
    assert abs(got["known"][0] - 0.15) < 1e-12 and abs(got["known"][1] - 0.02**0.5) < 1e-12


def test_missing_covariance_is_reported(spark):
    from tideline.operators.optimize import solve_weights

    mu = spark.createDataFrame([("u", "a", 0.1), ("u", "b", 0.2)], "k string, asset string, mu double")
    rows = [("u", "a", "a", 0.04), ("u", "b", "b", 0.04), ("u", "a", "b", None), ("u", "b", "a", 0.0)]
    cov = spark.createDataFrame(rows, "k string, i string, j string, cov double")
    for table in (cov, cov.where("i = j")):
        out = solve_weights(mu, table, ["k"]).collect()
        assert {r.status for r in out} == {"bad_covariance"} and len(out) == 4


def test_a_holding_without_returns_makes_the_portfolio_unknown(spark):
    from datetime import date, timedelta

    from tideline.operators import rebalance

    days = [date(2021, 1, 4) + timedelta(days=k) for k in range(12)]
    days = [d for d in days if d.weekday() < 5]
    rows = [("a", d, 0.01) for d in days] + [("b", d, None if k == 6 else 0.02) for k, d in enumerate(days)]
    returns = spark.createDataFrame(rows, "asset string, date date, r double")
    start = date(2021, 1, 5)
    held = [("known", start, "a", 0.5), ("known", start, "b", 0.5), ("lost", start, "a", 0.5), ("lost", start, "zz", 0.5)]
    weights = spark.createDataFrame(held, "portfolio string, rebalance_date date, asset string, weight double")
    got = rebalance.rebalanced_return(returns, weights, "2021-01-15").orderBy("date").collect()
    lost = [r for r in got if r.portfolio == "lost"]
    known = [r for r in got if r.portfolio == "known"]
    assert len(lost) == len(known) == 8 and all(r.r is None and r.cum_return is None for r in lost)
    assert [r.r is None for r in known] == [False] * 4 + [True] + [False] * 3
    assert known[3].cum_return == pytest.approx((1.015**4 - 1) * 100)
    assert all(r.cum_return is None for r in known[4:])


def test_a_quarter_without_returns_keeps_the_estimate(spark):
    from datetime import date

    from tideline.operators import estimators

    rows = [("a", date(2021, m, 4), 0.01) for m in (2, 5, 8)] + [("b", date(2021, 2, 4), 0.02), ("b", date(2021, 5, 4), None), ("b", date(2021, 8, 4), 0.04)]
    df = spark.createDataFrame(rows + [("c", date(2021, 2, 4), None)], "asset string, date date, r double")
    got = {(r.asset, r.period % 4): r.mu for r in estimators.ewm_mean_by_period(df).collect()}
    assert sorted(got) == [(x, q) for x in "ab" for q in range(3)]
    assert got["b", 1] == pytest.approx(got["b", 0]) and got["b", 2] > got["b", 0]


def test_frontier_ends_at_the_highest_return_and_names_assets_of_unknown_risk(spark):
    mu = spark.createDataFrame([("g", a, m) for a, m in (("a", 0.1), ("b", 0.3), ("c", 0.3), ("new", 0.9))], "g string, asset string, mu double")
    v = {("a", "a"): 0.04, ("b", "b"): 0.09, ("c", "c"): 0.18, ("a", "b"): 0.01, ("a", "c"): 0.0, ("b", "c"): 0.0}
    both = {**v, **{(j, i): x for (i, j), x in v.items()}}
    cov = spark.createDataFrame([("g", i, j, x) for (i, j), x in both.items()], "g string, i string, j string, cov double")
    got = optimize.solve_weights(mu, cov, ("g",), ("frontier", "min_vol"), points=5).toPandas()
    last = got[got.portfolio == "point_004"].set_index("asset")
    # Two assets share the highest return; the mix weighs them by inverse variance.
    assert last.weight.to_dict() == pytest.approx({"a": 0.0, "b": 2 / 3, "c": 1 / 3, "new": 0.0}, abs=1e-8)
    assert sorted(got.portfolio.unique()) == ["min_vol", *(f"point_{k:03d}" for k in range(5))]
    assert set(got[got.asset == "new"].status) == {"no_covariance"} and set(got[got.asset != "new"].status) == {"optimal"}
