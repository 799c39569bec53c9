"""Covariance and expected-return estimators on long returns ``(asset, date, n, r)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import business_ordinal, period_end, period_number
from tideline.functions.stats import span_decay
from tideline.operators.pairs import both_triangles, moment_name, pair_estimates, pair_moments
from tideline.operators.panel import between_years, complete_cases, with_day

FREQUENCY = 252

_COV_POWERS = [(0, 0), (1, 0), (0, 1), (1, 1)]
# Raw sums from which all centred moments up to x^3 y and x^2 y^2 follow.
SHRINKAGE_POWERS = [
    (0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1), (2, 1), (1, 2),
    (3, 0), (0, 3), (2, 2), (3, 1), (1, 3),
]


def _age(n: Column, as_of: Column) -> Column:
    return business_ordinal(as_of) - business_ordinal(n)


def _last_day(returns: DataFrame, as_of: str | None) -> Column:
    """Day number the weights count back from: given, or the last day of the panel."""
    if as_of is not None:
        return F.unix_date(F.lit(as_of).cast("date"))
    return returns.agg(F.max("n").alias("n")).select("n").scalar()


def _until(returns: DataFrame, as_of: str | None) -> DataFrame:
    return returns if as_of is None else returns.where(F.col("date") <= F.lit(as_of).cast("date"))


def _sample_estimate(frequency: int) -> Callable:
    """Sample covariance from the sums of a block pair; there is none from a single day."""

    def estimate(sums):
        n, x, y, xy = (sums[p] for p in ((0, 0), (1, 0), (0, 1), (1, 1)))
        return (xy - x * y / n) / (n - 1) * frequency, n < 2

    return estimate


def sample_cov(
    returns: DataFrame, keys: Sequence[str] = (), frequency: int = FREQUENCY, n_blocks: int | None = None
) -> DataFrame:
    """Annualised sample covariance over the days both assets have a return.

    Each series is centred by its own mean first, so that the sums of products
    keep their digits whatever the level of the values.
    """
    estimate = _sample_estimate(frequency)
    cov = pair_estimates(with_day(returns), _COV_POWERS, estimate, keys=keys, n_blocks=n_blocks, centred=True)
    return cov.withColumnRenamed("value", "cov")


def period_cov(
    returns: DataFrame, periods: dict[str, tuple[int, int]], frequency: int = FREQUENCY, n_blocks: int | None = None
) -> DataFrame:
    """Covariance of weekly mean returns per named range of years.

    Weeks are cut at the period boundaries and weeks in which some asset has no
    return are left out. All periods are computed in one job.
    """
    year = F.year("date")
    period = F.coalesce(*(F.when(year.between(lo, hi), F.lit(name)) for name, (lo, hi) in periods.items()))
    weekly = (
        between_years(returns, min(lo for lo, _ in periods.values()), max(hi for _, hi in periods.values()))
        .withColumn("period", period)
        .where(F.col("period").isNotNull())
        .groupBy("period", "asset", period_number(F.col("date"), "weekly").alias("n"))
        .agg(F.avg("r").alias("r"))
    )
    return sample_cov(complete_cases(weekly, ("period", "n"), "r"), ("period",), frequency, n_blocks)


def ewm_cov(
    returns: DataFrame,
    span: float = 180,
    frequency: int = FREQUENCY,
    as_of: str | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """Exponentially weighted covariance.

    Deviations are taken from each asset's plain mean; their products are
    averaged with weights that decay with the number of business days back.
    """
    base = _until(with_day(returns), as_of)
    centred = base.select(
        "asset",
        "n",
        (F.col("r") - F.avg("r").over(Window.partitionBy("asset"))).alias("x"),
        F.pow(F.lit(span_decay(span)), _age(F.col("n"), _last_day(base, as_of))).alias("w"),
    )
    powers = [(0, 0), (1, 1)]
    sums = pair_moments(centred, powers, value="x", weight="w", n_blocks=n_blocks)
    cov = F.col(moment_name(1, 1)) / F.col(moment_name(0, 0)) * frequency
    return both_triangles(sums, powers).select("i", "j", cov.alias("cov"))


def shrink_constant_correlation(
    sums: DataFrame, keys: Sequence[str] = (), frequency: int = FREQUENCY
) -> DataFrame:
    """Ledoit-Wolf shrinkage towards constant correlation, from raw pair sums.

    ``sums`` holds both triangles with the sums of :data:`SHRINKAGE_POWERS` over
    complete rows; ``keys`` are estimation dates or periods. Returns
    ``keys, i, j, cov, delta``: the shrunk covariance and the shrinkage
    intensity, which is one figure per group.
    """
    means = [f"{moment_name(p, q)} / x0y0 as e{p}{q}" for p, q in SHRINKAGE_POWERS[1:]]
    centred = (
        sums.where("x0y0 >= 2")
        .selectExpr(*keys, "i", "j", "x0y0 as t", *means)
        .selectExpr(
            *keys,
            "i",
            "j",
            "t",
            # E[(x-a)^2 (y-b)^2] and E[(x-a)^3 (y-b)] with a = E[x], b = E[y], multiplied out.
            "e22 - 2*e01*e21 - 2*e10*e12 + e01*e01*e20 + e10*e10*e02 + 4*e10*e01*e11 - 3*e10*e10*e01*e01 as m22",
            "e31 - 3*e10*e21 + 3*e10*e10*e11 - e01*e30 + 3*e10*e01*e20 - 3*e10*e10*e10*e01 as m31",
            "e11 - e10*e01 as h",
            "e20 - e10*e10 as h_i",
            "(e11 - e10*e01) * t / (t - 1) as s",
            "(e20 - e10*e10) * t / (t - 1) as v_i",
            "(e02 - e01*e01) * t / (t - 1) as v_j",
        )
        .selectExpr(
            *keys, "i", "j", "t", "s", "v_i", "v_j", "sqrt(v_i * v_j) as scale",
            "m22 - 2*h*s + s*s as pi", "m31 - h_i*s - h*v_i + v_i*s as theta",
        )
    )
    # Everything the intensity needs, summed over the off-diagonal in one pass.
    group = centred.groupBy(*keys).agg(
        *(
            F.expr(f"{how}(case when i != j then {what} end) as {name}")
            for how, what, name in (
                ("max", "t", "t"),
                ("avg", "try_divide(s, scale)", "r_bar"),
                ("sum", "pi", "pi"),
                ("sum", "sqrt(try_divide(v_j, v_i)) * theta", "rho"),
                ("sum", "s * s", "ss"),
                ("sum", "s * scale", "sf"),
                ("sum", "v_i * v_j", "ff"),
            )
        )
    )
    r_bar = F.col("r_bar")
    misfit = F.col("ss") - 2 * r_bar * F.col("sf") + r_bar * r_bar * F.col("ff")
    delta = F.try_divide(F.col("pi") - r_bar * F.col("rho"), misfit * F.col("t"))
    group = group.select(
        *keys, "r_bar", F.least(F.greatest(F.coalesce(delta, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("delta")
    )
    joined = centred.join(group, list(keys)) if keys else _beside(centred, group)
    target = "case when i = j then s else coalesce(r_bar * scale, 0D) end"
    return joined.selectExpr(
        *keys, "i", "j", f"(delta * {target} + (1 - delta) * s) * {frequency} as cov", "delta"
    )


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def ledoit_wolf_cov(
    returns: DataFrame, frequency: int = FREQUENCY, n_blocks: int | None = None
) -> DataFrame:
    """Shrunk covariance over the days on which every asset has a return."""
    rows = complete_cases(with_day(returns), ("n",), "r")
    sums = pair_moments(rows, SHRINKAGE_POWERS, n_blocks=n_blocks)
    return shrink_constant_correlation(both_triangles(sums, SHRINKAGE_POWERS), frequency=frequency)


def ewm_mean_return(
    returns: DataFrame, span: float = 500, frequency: int = FREQUENCY, as_of: str | None = None
) -> DataFrame:
    """Annualised exponentially weighted mean return per asset, not compounded."""
    base = _until(with_day(returns), as_of)
    w = F.when(F.col("r").isNotNull(), F.pow(F.lit(span_decay(span)), F.col("age")))
    return (
        base.withColumn("age", _age(F.col("n"), _last_day(base, as_of)))
        .groupBy("asset")
        .agg((F.try_divide(F.sum(w * F.col("r")), F.sum(w)) * frequency).alias("mu"))
    )


def correlation(cov: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Covariance to correlation, by joining the matrix with its own diagonal."""
    diagonal = cov.where(F.col("i") == F.col("j"))
    v_i = diagonal.select(*keys, "i", F.col("cov").alias("v_i"))
    v_j = diagonal.select(*keys, "j", F.col("cov").alias("v_j"))
    return (
        cov.join(v_i, [*keys, "i"])
        .join(v_j, [*keys, "j"])
        .select(*keys, "i", "j", F.try_divide(F.col("cov"), F.sqrt(F.col("v_i") * F.col("v_j"))).alias("corr"))
    )


def ewm_mean_by_period(
    returns: DataFrame, span: float = 500, frequency: int = FREQUENCY, freq: str = "quarterly"
) -> DataFrame:
    """Expected return as of the end of every period: ``(asset, period, mu)``.

    History is read once: each period keeps its decayed sums, and a running
    window ages the earlier sums by the business days between period ends. A
    period without a return keeps the estimate of the one before.
    """
    decay = F.lit(span_decay(span))
    base = with_day(returns).withColumn("period", period_number(F.col("date"), freq))
    end = business_ordinal(F.unix_date(period_end(F.col("period"), freq)))
    w = F.pow(decay, end - business_ordinal(F.col("n")))
    known = F.col("r").isNotNull()
    sums = (
        base.groupBy("asset", "period")
        .agg(F.sum(F.when(known, w * F.col("r")).otherwise(0.0)).alias("wr"), F.sum(F.when(known, w).otherwise(0.0)).alias("w"))
        .withColumn("end", end)
    )
    so_far = F.collect_list(F.struct("end", "wr", "w")).over(
        Window.partitionBy("asset").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    )

    def aged(field: str) -> Column:
        return F.aggregate(
            "so_far", F.lit(0.0), lambda acc, s: acc + s[field] * F.pow(decay, F.col("end") - s["end"])
        )

    return (
        sums.withColumn("so_far", so_far)
        .select("asset", "period", (F.try_divide(aged("wr"), aged("w")) * frequency).alias("mu"))
        .where(F.col("mu").isNotNull())
    )


def ledoit_wolf_by_period(
    returns: DataFrame, frequency: int = FREQUENCY, freq: str = "quarterly", n_blocks: int | None = None
) -> DataFrame:
    """Shrunk covariance as of the end of every period: ``(period, i, j, cov, delta)``.

    Pair sums are taken per period and accumulated, instead of rescanning the
    history for every date; the raw sums are centred afterwards because the
    mean moves with the date.
    """
    rows = complete_cases(with_day(returns), ("n",), "r").withColumn("period", period_number(F.col("date"), freq))
    sums = pair_moments(rows, SHRINKAGE_POWERS, keys=("period",), n_blocks=n_blocks)
    running = Window.partitionBy("i", "j").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    names = [moment_name(*p) for p in SHRINKAGE_POWERS]
    so_far = sums.select("period", "i", "j", *(F.sum(c).over(running).alias(c) for c in names))
    return shrink_constant_correlation(
        both_triangles(so_far, SHRINKAGE_POWERS, ("period",)), ("period",), frequency
    )
