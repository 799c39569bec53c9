"""Portfolio weights, values, performance and candidate search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISK_FREE = 0.02


def weights_table(weights: DataFrame, portfolios: Sequence[str] = ("max_sharpe", "min_vol")) -> DataFrame:
    """One row per asset that every named portfolio has a weight for."""
    grouped = weights.where(F.col("portfolio").isin(list(portfolios))).groupBy("asset")
    table = grouped.pivot("portfolio", list(portfolios)).agg(F.first("weight"))
    return table.dropna(subset=list(portfolios))


def equal_weights(assets: DataFrame, portfolio: str = "equal_wt") -> DataFrame:
    """``1 / N`` for each distinct asset."""
    names = assets.select("asset").distinct()
    size = names.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    return names.select(F.lit(portfolio).alias("portfolio"), "asset", (F.lit(1.0) / size).alias("weight"))


def clean_weights(weights: DataFrame, cutoff: float = 1e-4, digits: int = 5) -> DataFrame:
    """Weights below the cutoff become 0, the rest is rounded; no renormalisation."""
    w = F.col("weight")
    return weights.withColumn("weight", F.when(F.abs(w) < cutoff, F.lit(0.0)).otherwise(F.bround(w, digits)))


def portfolio_value(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight x price per portfolio, on days when no asset's price is missing.

    Weights act as unit holdings and are matched to assets by name. A day counts
    only if every holding is priced, so a holding that the panel does not know
    leaves its portfolio without values. One job serves all portfolios; the sum
    pre-aggregates before its shuffle.
    """
    holdings = weights.select("portfolio", "asset", "weight")
    sizes = holdings.groupBy("portfolio").agg(F.count(F.lit(1)).alias("want"))
    held = panel.select("asset", "date", "price").join(holdings, "asset")
    return (
        held.groupBy("portfolio", "date")
        .agg(F.sum(F.col("price") * F.col("weight")).alias("value"), F.count("price").alias("have"))
        .join(sizes, "portfolio")
        .where(F.col("have") == F.col("want"))
        .select("portfolio", "date", "value")
    )


def performance(
    weights: DataFrame, mu: DataFrame, cov: DataFrame, keys: Sequence[str] = (), rf: float = RISK_FREE
) -> DataFrame:
    """Expected return, volatility and Sharpe ratio per portfolio.

    A holding without an estimate makes the figure that needs it NULL, not smaller.
    """
    by = [*keys, "portfolio"]
    held = weights.where(F.col("weight") != 0)
    n = F.count(F.lit(1))
    gains = held.join(mu, [*keys, "asset"], "left").groupBy(*by).agg(
        F.when(F.count("mu") == n, F.sum(F.col("weight") * F.col("mu"))).alias("expected_return"), n.alias("n_held")
    )
    left = held.select(*by, F.col("asset").alias("i"), F.col("weight").alias("w_i"))
    right = held.select(*by, F.col("asset").alias("j"), F.col("weight").alias("w_j"))
    variance = (
        left.join(cov, [*keys, "i"])
        .join(right, [*by, "j"])
        .groupBy(*by)
        .agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("cov")).alias("variance"), F.count("cov").alias("n_pairs"))
    )
    complete = F.col("n_pairs") == F.col("n_held") * F.col("n_held")
    scored = gains.join(variance, by, "left").withColumn("volatility", F.when(complete, F.sqrt("variance")))
    return scored.select(*by, "expected_return", "volatility", _sharpe(rf).alias("sharpe"))


def _sharpe(rf: float) -> Column:
    return F.try_divide(F.col("expected_return") - rf, F.col("volatility"))


def candidates(
    mu: DataFrame, cov: DataFrame, keys: Sequence[str] = (), steps: int = 20, rf: float = RISK_FREE
) -> DataFrame:
    """Scored portfolios of one or two assets.

    Every asset alone, and every pair mixed in ``steps`` equal steps. Returns
    ``keys, i, j, w, expected_return, volatility, sharpe`` with ``w`` the share
    of ``i``.
    """
    variance_of = cov.where(F.col("i") == F.col("j")).select(*keys, F.col("i").alias("asset"), F.col("cov").alias("v"))
    facts = mu.select(*keys, "asset", "mu").join(variance_of, [*keys, "asset"])

    def of(leg: str) -> DataFrame:
        return facts.select(
            *keys, F.col("asset").alias(leg), F.col("mu").alias(f"m_{leg}"), F.col("v").alias(f"v_{leg}")
        )

    share = F.when(F.col("i") == F.col("j"), F.array(F.lit(steps))).otherwise(
        F.sequence(F.lit(1), F.lit(steps - 1))
    )
    mixed = (
        cov.where(F.col("i") <= F.col("j"))
        .join(of("i"), [*keys, "i"])
        .join(of("j"), [*keys, "j"])
        .withColumn("step", F.explode(share))
        .withColumn("w", F.col("step") / steps)
    )
    w, u = F.col("w"), 1 - F.col("w")
    variance = w * w * F.col("v_i") + u * u * F.col("v_j") + 2 * w * u * F.col("cov")
    scored = mixed.withColumn("expected_return", w * F.col("m_i") + u * F.col("m_j")).withColumn(
        "volatility", F.sqrt(F.greatest(variance, F.lit(0.0)))
    )
    return scored.select(*keys, "i", "j", "w", "expected_return", "volatility", _sharpe(rf).alias("sharpe"))


def best_candidates(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group the candidate of highest Sharpe ratio and that of lowest volatility.

    Both come out of one map-side combinable aggregate. Ties go to the
    alphabetically first pair and its smallest share.
    """
    record = F.struct("i", "j", "w", "expected_return", "volatility", "sharpe")
    order = (F.col("i"), F.col("j"), F.col("w"))
    best = scored.groupBy(*keys).agg(
        F.min_by(record, F.struct((-F.col("sharpe")).alias("k"), *order)).alias("max_sharpe"),
        F.min_by(record, F.struct(F.col("volatility").alias("k"), *order)).alias("min_vol"),
    )
    rows = [F.struct(F.lit(p).alias("portfolio"), F.col(p).alias("c")) for p in ("max_sharpe", "min_vol")]
    return best.select(*keys, F.inline(F.array(*rows))).select(*keys, "portfolio", "c.*")


def candidate_weights(chosen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chosen candidates as long weights ``(keys, portfolio, asset, weight)``."""
    first = F.struct(F.col("i").alias("asset"), F.col("w").alias("weight"))
    second = F.struct(F.col("j").alias("asset"), (1 - F.col("w")).alias("weight"))
    legs = F.when(F.col("i") == F.col("j"), F.array(first)).otherwise(F.array(first, second))
    return chosen.select(*keys, "portfolio", F.inline(legs))


def frontier_points(scored: DataFrame, keys: Sequence[str], buckets: int = 20) -> DataFrame:
    """Highest-return candidate per equal-width volatility bucket of each group."""
    bounds = scored.groupBy(*keys).agg(F.min("volatility").alias("lo"), F.max("volatility").alias("hi"))
    position = F.try_divide(F.col("volatility") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets
    slot = F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(buckets - 1)).cast("int")
    record = F.struct("i", "j", "w", "expected_return", "volatility", "sharpe")
    rank = F.struct((-F.col("expected_return")).alias("k"), "i", "j", "w")
    return (
        scored.join(bounds, list(keys))
        .groupBy(*keys, slot.alias("bucket"))
        .agg(F.min_by(record, rank).alias("c"))
        .select(*keys, "bucket", "c.*")
    )
