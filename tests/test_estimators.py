import numpy as np
import pandas as pd
import pytest

from conftest import to_wide
from tideline.operators import estimators
from tideline.operators.pairs import block_count, both_triangles, moment_name, pair_moments


def matrix(df, value="cov"):
    return df.toPandas().pivot(index="i", columns="j", values=value)


def close(got, expected, tolerance=1e-9):
    pd.testing.assert_frame_equal(
        got, expected, check_names=False, rtol=tolerance, atol=1e-12, check_like=True
    )


def ledoit_wolf(x):
    """Shrinkage towards constant correlation, straight from the paper's sums."""
    x = x.dropna().to_numpy()
    t, n = x.shape
    z = x - x.mean(axis=0)
    sample = z.T @ z / t
    s = sample * t / (t - 1)
    sd = np.sqrt(np.diag(s))
    off = ~np.eye(n, dtype=bool)
    r_bar = (s / np.outer(sd, sd))[off].mean()
    target = r_bar * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    pi = np.array([[np.mean((z[:, i] * z[:, j] - s[i, j]) ** 2) for j in range(n)] for i in range(n)])
    theta = np.array(
        [[np.mean((z[:, i] ** 2 - s[i, i]) * (z[:, i] * z[:, j] - s[i, j])) for j in range(n)] for i in range(n)]
    )
    rho = r_bar * np.outer(1 / sd, sd) * theta
    kappa = (pi - rho)[off].sum() / ((target - s)[off] ** 2).sum()
    delta = min(max(kappa / t, 0), 1)
    return delta, delta * target + (1 - delta) * s


@pytest.mark.parametrize("n_blocks", [1, 3, None])
def test_pair_sums_equal_a_self_join(returns_df, n_blocks):
    powers = [(0, 0), (1, 0), (0, 1), (2, 1), (1, 2)]
    got = both_triangles(pair_moments(returns_df, powers, n_blocks=n_blocks), powers).toPandas()
    wide = to_wide(returns_df, "r")
    assert len(got) == wide.shape[1] ** 2
    for row in got.itertuples():
        both = wide[[row.i, row.j]].dropna() if row.i != row.j else wide[[row.i]].dropna()
        x, y = both.iloc[:, 0], both.iloc[:, -1]
        for p, q in powers:
            assert getattr(row, moment_name(p, q)) == pytest.approx((x**p * y**q).sum(), rel=1e-9, abs=1e-12)


def test_sums_of_a_pair_are_not_shuffled(returns_df):
    """A block pair is summed over all its days by one task, also if the blocks are joined without a broadcast."""
    spark, key = returns_df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        sums = pair_moments(returns_df, [(1, 1)], n_blocks=3)
        plan = sums._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert "MapInArrow" in plan[0] and not any("Aggregate [i#" in line for line in plan)
        assert sums.count() == 15
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("n_blocks", [2, 5])
def test_pair_sums_by_keys(spark, n_blocks):
    """Null keys are a group; blocks of different keys do not meet."""
    rng = np.random.default_rng(1)
    rows = [(k, f"a{a}", n, float(rng.normal())) for k in (None, 1, 2) for a in range(9) for n in range(700) if rng.random() < 0.4]
    sums = pair_moments(spark.createDataFrame(rows, "k int, asset string, n int, r double"), [(0, 0), (1, 1)], keys=("k",), n_blocks=n_blocks)
    got = {(r.k, *sorted((r.i, r.j))): (r.x0y0, r.x1y1) for r in sums.collect()}
    assert len(got) == 3 * 45
    days = {}
    for k, a, n, r in rows:
        days.setdefault((k, a), {})[n] = r
    for (k, i, j), (n, xy) in got.items():
        x, y = days[k, i], days[k, j]
        assert n == len(x.keys() & y.keys())
        assert xy == pytest.approx(sum(x[d] * y[d] for d in x.keys() & y.keys()), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_sample_covariance(returns_df, n_blocks):
    close(matrix(estimators.sample_cov(returns_df, n_blocks=n_blocks)), to_wide(returns_df, "r").cov() * 252)


def test_covariance_of_series_without_common_days(make):
    from tideline.operators.panel import with_day

    r = with_day(make([("x", "2021-01-04", 1.0), ("x", "2021-01-05", 2.0), ("y", "2022-01-04", 1.0), ("y", "2022-01-05", 3.0)]))
    rows = estimators.sample_cov(r.withColumnRenamed("price", "r"), n_blocks=1).collect()
    assert {(row.i, row.j) for row in rows} == {("x", "x"), ("y", "y")}


def test_period_covariance(returns_df):
    got = estimators.period_cov(returns_df, {"old": (2015, 2017), "new": (2018, 2019)}, n_blocks=1)
    wide = to_wide(returns_df, "r")
    for name, years in (("old", slice("2015", "2017")), ("new", slice("2018", "2019"))):
        expected = wide.loc[years].resample("W").mean().dropna().cov() * 252
        close(matrix(got.where(f"period = '{name}'")), expected)


@pytest.mark.parametrize("span", [5, 180])
def test_ewm_covariance(returns_df, span):
    wide = to_wide(returns_df, "r")
    centred = wide - wide.mean()
    expected = pd.DataFrame(
        {j: {i: (centred[i] * centred[j]).ewm(span=span).mean().iloc[-1] * 252 for i in wide} for j in wide}
    )
    close(matrix(estimators.ewm_cov(returns_df, span, n_blocks=2)), expected)
    close(matrix(estimators.ewm_cov(returns_df, span, as_of="2019-12-31", n_blocks=1)), expected)


@pytest.mark.parametrize("span", [5, 500])
def test_ewm_mean(returns_df, span):
    expected = to_wide(returns_df, "r").ewm(span=span).mean().iloc[-1] * 252
    got = estimators.ewm_mean_return(returns_df, span).toPandas().set_index("asset")["mu"]
    pd.testing.assert_series_equal(got.sort_index(), expected, check_names=False)


def test_ledoit_wolf(returns_df):
    out = estimators.ledoit_wolf_cov(returns_df, n_blocks=2)
    delta, expected = ledoit_wolf(to_wide(returns_df, "r"))
    got = matrix(out)
    assert 0 <= delta <= 1 and out.select("delta").distinct().count() == 1
    assert out.first().delta == pytest.approx(delta, rel=1e-8)
    np.testing.assert_allclose(got.to_numpy(), expected * 252, rtol=1e-8)
    np.testing.assert_allclose(got.to_numpy(), got.to_numpy().T, rtol=1e-12)


def test_correlation(returns_df):
    got = matrix(estimators.correlation(estimators.sample_cov(returns_df, n_blocks=1)), "corr")
    cov = to_wide(returns_df, "r").cov()
    sd = np.sqrt(np.diag(cov))
    close(got, cov / np.outer(sd, sd))


def test_estimates_by_quarter_equal_a_rescan(returns_df):
    wide = to_wide(returns_df, "r")
    mu = estimators.ewm_mean_by_period(returns_df, 20).toPandas()
    cov = estimators.ledoit_wolf_by_period(returns_df, n_blocks=2).toPandas()
    for period in (2015 * 4 + 3, 2017 * 4 + 1, 2019 * 4 + 3):
        known = wide[: pd.Period(year=period // 4, quarter=period % 4 + 1, freq="Q").end_time]
        expected = known.ewm(span=20).mean().iloc[-1].dropna() * 252
        got = mu[mu["period"] == period].set_index("asset")["mu"].sort_index()
        pd.testing.assert_series_equal(got, expected, check_names=False)
        delta, shrunk = ledoit_wolf(known)
        part = cov[cov["period"] == period]
        assert part["delta"].iloc[0] == pytest.approx(delta, rel=1e-7, abs=1e-9)
        np.testing.assert_allclose(part.pivot(index="i", columns="j", values="cov").to_numpy(), shrunk * 252, rtol=1e-7)


def test_sample_cov_of_small_moves_at_a_high_level(spark):
    from datetime import date

    from tideline.operators.estimators import sample_cov

    days = [date(2020, 1, d) for d in (1, 2, 3, 6, 7, 8, 9, 10, 13, 14)]
    rows = [("a", d, 1e9 + k % 3) for k, d in enumerate(days)]
    returns = spark.createDataFrame(rows, "asset string, date date, r double")
    expected = np.cov([k % 3 for k in range(10)]) * 252
    assert abs(sample_cov(returns).first().cov - expected) < 1e-6


@pytest.mark.parametrize("n_blocks", [1, 3, 40])
def test_sample_covariance_of_gappy_series(spark, n_blocks):
    """Series that share all, some, one or no day, in several blocks and groups; each series is centred by itself."""
    rng = np.random.default_rng(3)
    rows = [(k, f"a{a:02d}", n, 1e6 + float(rng.normal())) for k in (None, 1) for a in range(12) for n in range(40 * (a % 3), 500) if a < 6 or rng.random() < 0.3]
    rows += [(1, "late", 499, 5.0), (1, "late", 500, 7.0), (1, "apart", 900, 1.0), (1, "apart", 901, 2.0)]
    got = estimators.sample_cov(spark.createDataFrame(rows, "k int, asset string, n int, r double"), ("k",), n_blocks=n_blocks).collect()
    found = {(r.k, r.i, r.j): r.cov for r in got}
    assert len(found) == len(got)
    series = {}
    for k, a, n, r in rows:
        series.setdefault((k, a), {})[n] = r
    expected = {}
    for (k, i), x in series.items():
        for (other, j), y in series.items():
            days = sorted(x.keys() & y.keys())
            if k == other and days:
                expected[k, i, j] = np.cov([x[d] for d in days], [y[d] for d in days])[0, 1] * 252 if len(days) > 1 else None
    assert found.keys() == expected.keys()
    for pair, cov in expected.items():
        assert found[pair] == (None if cov is None else pytest.approx(cov, rel=1e-6, abs=1e-6)), pair
        assert found[pair] == found[pair[0], pair[2], pair[1]]


def test_pairs_leave_python_as_matrices(spark):
    """Rows of Python hold many pairs each; before, every pair was a row with two names and four sums."""
    rows = [(f"a{a}", n, float((a * n) % 7)) for a in range(60) for n in range(30)]
    cov = estimators.sample_cov(spark.createDataFrame(rows, "asset string, n int, r double"), n_blocks=3)
    plan = cov._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("MapInArrow" in line and "values#" in line for line in plan)
    assert not any("Window" in line for line in plan)
    assert cov.count() == 3600 and cov.select("i", "j").distinct().count() == 3600


def test_block_count():
    assert [block_count(n) for n in (0, 5, 1_000, 6_000, 60_000)] == [1, 1, 7, 12, 118]
