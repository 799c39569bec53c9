"""Long-only optimal weights for many universes at once.

Both objectives reduce to one problem: minimise ``y'Vy / 2 - b'y`` over
``y >= 0`` and scale ``y`` to sum 1. ``b = 1`` gives the least volatile
portfolio, ``b = mu - rf`` the one of highest Sharpe ratio, and blends of the
two trace the efficient frontier. Universes are solved in parallel, one small
dense problem per group. A universe too large for one dense problem is solved
exactly by :func:`solve_large`, which keeps the matrix distributed and only
brings the assets that carry weight together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.portfolio import RISK_FREE
from tideline.session import has_checkpoint_dir

OBJECTIVES = ("max_sharpe", "min_vol")
DENSE_LIMIT = 1000


def _group_solver(
    columns: Sequence[str], objectives: Sequence[str], rf: float, points: int, limit: int | None
) -> Callable:
    """Dense solver of one universe; self-contained so that executors need no import of this package."""
    key_columns, objectives = list(columns), list(objectives)

    def solve(key, mu_rows, cov_rows):
        import numpy as np
        import pandas as pd

        def nonnegative_quadratic(v, b):
            """Active-set method: grow the support by the steepest asset, shrink it where weights turn negative."""
            size, y = len(b), np.zeros(len(b))
            v = v + np.eye(size) * (1e-10 * max(np.trace(v) / size, 1e-300))
            support = np.zeros(size, dtype=bool)
            tolerance = 1e-10 * max(np.abs(b).max(), 1e-300)
            done = False
            for _ in range(20 * size + 20):
                slope = np.where(support, -np.inf, b - v @ y)
                entering = int(np.argmax(slope))
                if slope[entering] <= tolerance:
                    done = True
                    break
                support[entering] = True
                while True:
                    idx = np.flatnonzero(support)
                    step = np.zeros(size)
                    step[idx] = np.linalg.solve(v[np.ix_(idx, idx)], b[idx])
                    falling = idx[step[idx] <= 0]
                    if len(falling) == 0:
                        y = step
                        break
                    ratio = y[falling] / (y[falling] - step[falling])
                    y = y + ratio.min() * (step - y)
                    support[falling[ratio <= ratio.min()]] = False
                    y[~support] = 0.0
            return y, done

        frames = []
        mu_rows = mu_rows.dropna(subset=["mu"]).sort_values("asset")
        held = np.intersect1d(mu_rows["asset"].to_numpy(dtype=str), cov_rows["i"].to_numpy(dtype=str))
        if limit is not None and len(held) > limit:
            raise ValueError(f"{len(held)} assets in one universe: use solve_large for more than {limit}")
        size = len(held)
        if size:
            mu = mu_rows.set_index("asset")["mu"].reindex(held).to_numpy()
            cov_rows = cov_rows[cov_rows["i"].isin(held) & cov_rows["j"].isin(held)]
            # A pair without an entry is unknown, not uncorrelated.
            v = np.full((size, size), np.nan)
            v[np.searchsorted(held, cov_rows["i"]), np.searchsorted(held, cov_rows["j"])] = cov_rows["cov"]
            spread = max(mu.max() - mu.min(), 1e-300)
            for objective in objectives:
                if objective == "frontier":
                    # From the least volatile (t = 0) towards the highest return, which the last point has.
                    ends = [*(1 + (mu - mu.max()) / spread * t / (1 - t) for t in np.linspace(0, 0.99, points - 1)), None]
                    targets = [(f"point_{k:03d}", b) for k, b in enumerate(ends)]
                else:
                    targets = [(objective, mu - rf if objective == "max_sharpe" else np.ones(size))]
                for name, b in targets:
                    if np.isnan(v).any():
                        y, status = np.full(size, np.nan), "bad_covariance"
                    else:
                        # Of several assets with the highest return, the least volatile mix.
                        some = np.flatnonzero(mu == mu.max()) if b is None else np.arange(size)
                        y = np.zeros(size)
                        y[some], done = nonnegative_quadratic(v[np.ix_(some, some)], np.ones(len(some)) if b is None else b)
                        status = "not_converged" if not done else "optimal" if y.sum() > 0 else "no_excess_return"
                    solved = y.sum() > 0
                    frames.append(
                        pd.DataFrame(
                            {
                                "portfolio": name,
                                "asset": held,
                                "weight": y / y.sum() if solved else np.nan,
                                # Scale of the unnormalised solution, used to price further assets.
                                "scale": y.sum() if solved else np.nan,
                                "status": status,
                            }
                        )
                    )
        # An asset of unknown risk is not held, and is named.
        unknown = np.setdiff1d(mu_rows["asset"].to_numpy(dtype=str), held)
        for name in dict.fromkeys(f["portfolio"].iat[0] for f in frames) if len(unknown) else ():
            frames.append(pd.DataFrame({"portfolio": name, "asset": unknown, "weight": 0.0, "scale": np.nan, "status": "no_covariance"}))
        out = pd.concat(frames) if frames else pd.DataFrame(columns=["portfolio", "asset", "weight", "scale", "status"])
        for position, column in enumerate(key_columns):
            out.insert(position, column, [key[position]] * len(out))
        return out

    return solve


def _weight_schema(mu: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [mu.schema[k] for k in keys]
        + [T.StructField(c, T.StringType()) for c in ("portfolio", "asset")]
        + [T.StructField(c, T.DoubleType()) for c in ("weight", "scale")]
        + [T.StructField("status", T.StringType())]
    )


def solve_weights(
    mu: DataFrame,
    cov: DataFrame,
    keys: Sequence[str],
    objectives: Sequence[str] = OBJECTIVES,
    rf: float = RISK_FREE,
    points: int = 20,
    limit: int | None = DENSE_LIMIT,
) -> DataFrame:
    """Optimal long-only weights per universe: ``keys, portfolio, asset, weight, status``.

    ``mu`` is ``keys, asset, mu`` and ``cov`` ``keys, i, j, cov`` with both
    triangles. The objective ``frontier`` yields ``points`` portfolios. Without
    any asset above ``rf`` the max-Sharpe weights are NULL and say so in
    ``status``, and so they are where a covariance is missing (``bad_covariance``). A universe above ``limit`` assets is refused, not truncated.
    """
    return _solve(mu, cov, keys, objectives, rf, points, limit).drop("scale")


def _solve(mu, cov, keys, objectives, rf, points, limit) -> DataFrame:
    left = mu.select(*keys, "asset", "mu")
    # Both inputs may stem from the same table, so the second one's keys get names of their own.
    right = cov.select(*(F.col(k).alias(f"cov_{k}") for k in keys), "i", "j", "cov")
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"cov_{k}" for k in keys))).applyInPandas(
        _group_solver(keys, objectives, rf, points, limit), _weight_schema(mu, keys)
    )


def solve_large(
    mu: DataFrame,
    cov: DataFrame,
    keys: Sequence[str],
    objective: str = "min_vol",
    rf: float = RISK_FREE,
    start: int = 200,
    grow: int = 100,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Exact weights for universes whose matrix is too large for one task.

    Only a working set of assets is solved densely. A distributed pass over the
    matrix then finds assets that would improve the solution; the ``grow`` best
    of each universe join the set, assets of zero weight leave it, and the loop
    ends when no asset improves anything. Then the optimality conditions hold
    for the whole universe, so the result is that of the full problem.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    if not has_checkpoint_dir(mu.sparkSession):
        raise ValueError("solve_large iterates: set spark.checkpoint.dir to a folder all executors share")
    keys = list(keys)
    pull = F.col("mu") - rf if objective == "max_sharpe" else F.lit(1.0)
    variance = cov.where(F.col("i") == F.col("j")).select(*keys, F.col("i").alias("asset"), F.col("cov").alias("v"))
    assets = mu.where(F.col("mu").isNotNull()).join(variance, [*keys, "asset"]).withColumn("b", pull).checkpoint()
    first = Window.partitionBy(*keys).orderBy(F.try_divide(F.col("b") * F.abs("b"), F.col("v")).desc(), "asset")
    working = assets.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= start).select(*keys, "asset")
    while True:
        inside = working.select(*keys, F.col("asset").alias("i")).join(
            cov, [*keys, "i"]
        ).join(working.select(*keys, F.col("asset").alias("j")), [*keys, "j"])
        solved = _solve(
            assets.join(working, [*keys, "asset"], "left_semi"), inside, keys, [objective], rf, 0, None
        ).checkpoint()
        support = solved.where(F.col("weight") > 0)
        load = (
            cov.join(
                support.select(*keys, F.col("asset").alias("j"), (F.col("weight") * F.col("scale")).alias("y")),
                [*keys, "j"],
            )
            .groupBy(*keys, F.col("i").alias("asset"))
            .agg(F.sum(F.col("cov") * F.col("y")).alias("load"))
        )
        # An asset improves the solution where its pull exceeds its load.
        gain = F.col("b") - F.coalesce("load", F.lit(0.0))
        better = (
            assets.join(load, [*keys, "asset"], "left")
            .join(working, [*keys, "asset"], "left_anti")
            .withColumn("gain", gain)
            .where(F.col("gain") > tolerance * F.greatest(F.abs("b"), F.lit(1e-12)))
        )
        best = Window.partitionBy(*keys).orderBy(F.col("gain").desc(), "asset")
        entering = (
            better.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= grow).select(*keys, "asset")
        ).checkpoint()
        if entering.isEmpty():
            break
        working = support.select(*keys, "asset").unionByName(entering).checkpoint()
    # Assets outside the working set share the fate of their universe.
    fate = solved.groupBy(*keys).agg(F.first("status").alias("status"))
    rest = assets.join(working, [*keys, "asset"], "left_anti").join(fate, keys, "left").select(
        *keys,
        F.lit(objective).alias("portfolio"),
        "asset",
        F.when(F.col("status") == "optimal", F.lit(0.0)).alias("weight"),
        "status",
    )
    return solved.drop("scale").unionByName(rest)
