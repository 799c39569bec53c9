"""Registered queries: every operator run over the shipped tables.

The panel has ten assets (supplier region x line status) priced daily by the
average line price. Dates leave as ISO strings and doubles rounded, so that
results compare equal across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.stats import half_up
from tideline.operators import estimators, measure, optimize, panel, portfolio, rebalance, returns, rolling
from tideline.operators.pairs import block_count
from tideline.operators.resample import resample
from tideline.session import stored
from tideline.sources.sheet import unpivot_pairs
from tideline.sources.star import (
    MARKETS,
    PANEL_END,
    PANEL_START,
    market_observations,
    supplier_observations,
    table,
)

# The published weights of the ten-asset study, in asset order.
PUBLISHED_WEIGHTS = {
    "max_sharpe": [0.0, 0.0, 0.28946, 0.0, 0.28095, 0.07064, 0.06948, 0.28946, 0.0, 0.0],
    "min_vol": [0.0, 0.26472, 0.18006, 0.00107, 0.33729, 0.0, 0.0239, 0.18006, 0.0077, 0.00521],
}
PORTFOLIOS = ("max_sharpe", "min_vol", "equal_wt")
COV_PERIODS = {"1995-1999": (1995, 1999), "2000-2001": (2000, 2001)}

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def edge(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Dates to ISO strings; doubles rounded, except observed prices, which are exact."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        rounded = isinstance(field.dataType, T.DoubleType) and digits is not None and field.name != "price"
        return F.round(c, digits).alias(field.name) if rounded else c

    return df.select(*(plain(f) for f in df.schema.fields))


def query(digits: int | None = 4, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function, by default under its own name."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge(fn(spark, sf_dir), digits)

        REGISTRY[name or fn.__name__] = run
        return fn

    return register


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.clean_prices(market_observations(spark, sf_dir), PANEL_START, PANEL_END, strict=True)


def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.daily_returns(prices(spark, sf_dir))


def published_weights(spark: SparkSession) -> DataFrame:
    rows = [(p, a, w) for p, ws in PUBLISHED_WEIGHTS.items() for a, w in zip(MARKETS, ws)]
    return spark.createDataFrame(rows, "portfolio string, asset string, weight double")


def all_weights(spark: SparkSession) -> DataFrame:
    published = published_weights(spark)
    return published.unionByName(portfolio.equal_weights(published))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.portfolio_value(prices(spark, sf_dir), all_weights(spark))


# --- panel -------------------------------------------------------------------


@query(name="unpivot_pairs")
def pair_sheet(spark, sf_dir):
    obs = market_observations(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("asset").orderBy("date"))
    sheet = (
        obs.withColumn("asset", panel.named("asset", MARKETS))
        .withColumn("k", place)
        .groupBy("k")
        .pivot("asset", MARKETS)
        .agg(F.first(F.col("date").cast("string")).alias("d"), F.first("price").alias("p"))
        .drop("k")
    )
    names = [name for k, asset in enumerate(MARKETS, start=1) for name in (f"date{k}", asset)]
    return unpivot_pairs(sheet.toDF(*names), "yyyy-MM-dd")


@query()
def business_calendar(spark, sf_dir):
    return panel.business_calendar(
        table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    )


@query()
def clean_prices(spark, sf_dir):
    return prices(spark, sf_dir).select("asset", "date", "price")


@query(None)
def ffill_prices(spark, sf_dir):
    return panel.ffill(prices(spark, sf_dir)).select("asset", "date", "px")


@query()
def series_quality(spark, sf_dir):
    return panel.series_quality(market_observations(spark, sf_dir))


@query()
def asset_subset(spark, sf_dir):
    return panel.asset_subset(prices(spark, sf_dir), [MARKETS[0], MARKETS[9]]).select("asset", "date", "price")


@query(None)
def panel_wide(spark, sf_dir):
    return panel.wide(prices(spark, sf_dir), MARKETS)


@query(None)
def panel_tail(spark, sf_dir):
    return panel.tail(panel.wide(prices(spark, sf_dir), MARKETS))


@query()
def complete_case(spark, sf_dir):
    return panel.complete_cases(prices(spark, sf_dir)).select("asset", "date", "price")


# --- returns -----------------------------------------------------------------


@query(6)
def daily_returns(spark, sf_dir):
    return market_returns(spark, sf_dir).select("asset", "date", "r")


@query(6)
def returns_wide(spark, sf_dir):
    return panel.wide(market_returns(spark, sf_dir), MARKETS, "r")


def _lagged(spark, sf_dir, trading_days: int = 252) -> tuple[DataFrame, dict[str, int]]:
    lags = returns.horizons(trading_days)
    return returns.lagged_returns(prices(spark, sf_dir), lags), lags


@query()
def lagged_returns(spark, sf_dir):
    df, lags = _lagged(spark, sf_dir)
    return df.select("asset", "date", *(f"Return_{h}" for h in lags))


@query()
def lagged_returns_360(spark, sf_dir):
    df, lags = _lagged(spark, sf_dir, 360)
    return df.select("asset", "date", *(f"Return_{h}" for h in lags))


@query()
def cumulative_return(spark, sf_dir):
    return returns.cumulative_return(prices(spark, sf_dir)).select("asset", "date", "Cum_Return")


@query()
def multi_period_return(spark, sf_dir):
    yearly = market_returns(spark, sf_dir).withColumn("year", F.year("date"))
    return returns.multi_period_return(yearly, ("asset", "year"))


# --- rolling and expanding features --------------------------------------------


def _shapes(spark, sf_dir, *families: str) -> DataFrame:
    df, lags = _lagged(spark, sf_dir)
    frames = rolling.return_shape_frames(lags, families)
    lean = df.select("asset", "date", "n", *dict.fromkeys(f.column for f in frames))
    return rolling.shape_statistics(lean, frames).select("asset", "date", *(name for f in frames for name in f.outputs))


@query()
def rolling_mean(spark, sf_dir):
    df, lags = _lagged(spark, sf_dir)
    frames = rolling.return_mean_frames(lags)
    return rolling.rolling_mean(df, frames).select("asset", "date", *(f.output for f in frames))


@query()
def rolling_std(spark, sf_dir):
    return _shapes(spark, sf_dir, "std")


@query()
def rolling_quantiles(spark, sf_dir):
    return _shapes(spark, sf_dir, "quantile")


@query()
def rolling_iqr(spark, sf_dir):
    return _shapes(spark, sf_dir, "iqr")


@query()
def rolling_skew(spark, sf_dir):
    return _shapes(spark, sf_dir, "skew")


@query()
def rolling_kurtosis(spark, sf_dir):
    return _shapes(spark, sf_dir, "kurtosis")


@query()
def rolling_range(spark, sf_dir):
    return _shapes(spark, sf_dir, "range")


@query()
def expanding_moments(spark, sf_dir):
    return rolling.expanding_moments(market_returns(spark, sf_dir)).select(
        "asset", "date", "Cum_STD", "Cum_Range", "Cum_Skew", "Cum_Kurtosis"
    )


@query()
def expanding_quantiles(spark, sf_dir):
    lean = market_returns(spark, sf_dir).select("asset", "date", "n", "r")
    return rolling.expanding_quantiles(lean).select("asset", "date", *rolling.EXPANDING_QUANTILES)


@query()
def feature_table(spark, sf_dir):
    return rolling.extract_features(prices(spark, sf_dir))


# --- resampling ----------------------------------------------------------------


@query(6)
def resample_week(spark, sf_dir):
    return resample(market_returns(spark, sf_dir), "weekly", mean_return=F.avg("r")).drop("freq", "n")


@query()
def resample_month(spark, sf_dir):
    return resample(prices(spark, sf_dir), "monthly", mean_price=F.avg("price")).drop("freq", "n")


@query()
def resample_quarter(spark, sf_dir):
    return resample(prices(spark, sf_dir), "quarterly", mean_price=F.avg("price")).drop("freq", "n")


@query(6)
def resample_year(spark, sf_dir):
    return resample(
        market_returns(spark, sf_dir),
        "annual",
        mean_price=F.avg("price"),
        mean_return=F.avg("r"),
        std_return=F.stddev_samp("r"),
    ).drop("freq", "n")


# --- estimators ----------------------------------------------------------------


def shrunk_cov(r: DataFrame) -> DataFrame:
    return estimators.ledoit_wolf_cov(r)


def expected_returns(r: DataFrame) -> DataFrame:
    return estimators.ewm_mean_return(r, as_of=PANEL_END)


@query()
def cov_sample(spark, sf_dir):
    return estimators.sample_cov(market_returns(spark, sf_dir))


@query(None)
def cov_suppliers(spark, sf_dir):
    """A wide, sparse panel: one asset per supplier, paired block by block."""
    sparse = panel.clean_prices(supplier_observations(spark, sf_dir), PANEL_START, PANEL_END, strict=True)
    # Only sizes the blocks; counted on the table, the panel need not be made for it.
    suppliers = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey")).first()[0]
    cov = estimators.sample_cov(returns.daily_returns(sparse), n_blocks=block_count(suppliers))
    # Rounded to two digits here, since edge() would cost more than the covariance.
    return cov.withColumn("cov", half_up(F.col("cov"), 2))


@query()
def cov_by_period(spark, sf_dir):
    return estimators.period_cov(market_returns(spark, sf_dir), COV_PERIODS)


@query()
def cov_ewm(spark, sf_dir):
    return estimators.ewm_cov(market_returns(spark, sf_dir), as_of=PANEL_END)


@query()
def cov_ledoit_wolf(spark, sf_dir):
    return shrunk_cov(market_returns(spark, sf_dir))


@query()
def mu_ewm(spark, sf_dir):
    return expected_returns(market_returns(spark, sf_dir))


@query()
def correlation(spark, sf_dir):
    return estimators.correlation(estimators.sample_cov(market_returns(spark, sf_dir)))


@query()
def near_duplicates(spark, sf_dir):
    cov = estimators.sample_cov(market_returns(spark, sf_dir))
    return panel.near_duplicates(estimators.correlation(cov), at_least=0.05)


# --- portfolios ----------------------------------------------------------------


def universes(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimates of the markets of each line status; each status is one universe."""
    cov = stored(shrunk_cov(r)).withColumn("universe", F.substring_index("i", "_", -1))
    return (
        expected_returns(r).withColumn("universe", F.substring_index("asset", "_", -1)),
        cov.where(F.col("universe") == F.substring_index("j", "_", -1)),
    )


def scored_candidates(r: DataFrame) -> DataFrame:
    return portfolio.candidates(*universes(r), ("universe",))


@query(5)
def weights_table(spark, sf_dir):
    days = market_observations(spark, sf_dir).groupBy("asset").agg(F.count("price").alias("n_prices"))
    return portfolio.weights_table(published_weights(spark)).join(days, "asset")


@query(6)
def weights_equal(spark, sf_dir):
    return portfolio.equal_weights(market_observations(spark, sf_dir))


@query(5)
def clean_weights(spark, sf_dir):
    spent = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.format_string("S%08d", "l_suppkey").alias("asset"))
        .agg(F.sum("l_extendedprice").alias("spent"))
    )
    total = spent.agg(F.sum("spent").alias("t")).select("t").scalar()
    return portfolio.clean_weights(spent.select("asset", (F.col("spent") / total).alias("weight")))


@query()
def portfolio_value(spark, sf_dir):
    return values(spark, sf_dir)


@query()
def portfolio_performance(spark, sf_dir):
    r = market_returns(spark, sf_dir)
    return portfolio.performance(all_weights(spark), expected_returns(r), shrunk_cov(r))


@query()
def frontier_points(spark, sf_dir):
    return portfolio.frontier_points(scored_candidates(market_returns(spark, sf_dir)), ("universe",))


@query()
def best_candidate(spark, sf_dir):
    return portfolio.best_candidates(scored_candidates(market_returns(spark, sf_dir)), ("universe",))


def _solved(spark, sf_dir, *objectives: str) -> DataFrame:
    mu, cov = universes(market_returns(spark, sf_dir))
    return optimize.solve_weights(mu, cov, ("universe",), objectives)


@query(5)
def weights_max_sharpe(spark, sf_dir):
    return portfolio.clean_weights(_solved(spark, sf_dir, "max_sharpe"))


@query(5)
def weights_min_vol(spark, sf_dir):
    return portfolio.clean_weights(_solved(spark, sf_dir, "min_vol"))


@query()
def efficient_frontier(spark, sf_dir):
    mu, cov = universes(market_returns(spark, sf_dir))
    points = optimize.solve_weights(mu, cov, ("universe",), ("frontier",))
    return portfolio.performance(points, mu, cov, ("universe",))


# --- measurement -----------------------------------------------------------------


@query()
def portfolio_summary(spark, sf_dir):
    return measure.portfolio_summary(values(spark, sf_dir))


@query()
def return_histogram(spark, sf_dir):
    return measure.return_histogram(values(spark, sf_dir))


@query()
def sharpe_annual(spark, sf_dir):
    return panel.wide(measure.annual_sharpe(values(spark, sf_dir)), PORTFOLIOS, "sharpe", "portfolio")


@query()
def return_comparison(spark, sf_dir):
    return measure.return_comparison(values(spark, sf_dir), "1997-01-01", PORTFOLIOS)


@query()
def asset_summary(spark, sf_dir):
    return measure.asset_summary(market_returns(spark, sf_dir))


@query()
def asset_histogram(spark, sf_dir):
    return measure.histogram(market_returns(spark, sf_dir), 40, ("asset",))


@query()
def linear_trend(spark, sf_dir):
    observed = supplier_observations(spark, sf_dir)
    return measure.linear_trend(panel.with_day(observed))


@query()
def iqr_by_frequency(spark, sf_dir):
    return measure.iqr_by_frequency(prices(spark, sf_dir))


# --- rebalancing -------------------------------------------------------------------


def mu_as_of(r: DataFrame) -> DataFrame:
    return rebalance.dated(estimators.ewm_mean_by_period(r), rebalance.rebalance_dates(r))


def cov_as_of(r: DataFrame) -> DataFrame:
    by_quarter = estimators.ledoit_wolf_by_period(r)
    return rebalance.dated(by_quarter, rebalance.rebalance_dates(r))


def candidate_weights_by_rebalance(r: DataFrame) -> DataFrame:
    keys = ("rebalance_date",)
    scored = portfolio.candidates(mu_as_of(r), stored(cov_as_of(r)), keys)
    return stored(portfolio.candidate_weights(portfolio.best_candidates(scored, keys), keys))


@query()
def rebalance_dates(spark, sf_dir):
    return rebalance.rebalance_dates(prices(spark, sf_dir)).select("rebalance_date")


@query()
def mu_by_rebalance(spark, sf_dir):
    return mu_as_of(market_returns(spark, sf_dir))


@query()
def cov_by_rebalance(spark, sf_dir):
    return cov_as_of(market_returns(spark, sf_dir))


@query(5)
def weights_by_rebalance(spark, sf_dir):
    r = market_returns(spark, sf_dir)
    return portfolio.clean_weights(optimize.solve_weights(mu_as_of(r), cov_as_of(r), ("rebalance_date",)))


@query()
def rebalance_turnover(spark, sf_dir):
    return rebalance.turnover(candidate_weights_by_rebalance(market_returns(spark, sf_dir)))


@query()
def rebalanced_return(spark, sf_dir):
    r = market_returns(spark, sf_dir)
    held = rebalance.rebalanced_return(r, candidate_weights_by_rebalance(r), PANEL_END)
    # The fixture's prices swing so much that compounded returns only fit a log scale.
    return held.select("portfolio", "date", "r", F.log1p(F.col("cum_return") / 100).alias("log_growth"))

