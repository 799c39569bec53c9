"""Rolling and expanding risk features, all in built-in expressions.

A frame of ``k`` days is right-closed: it holds the days ``(t - k, t]``.

Spark re-evaluates a sliding frame from scratch for every row, which costs
rows x frame. Three shapes avoid that here:

* Moments and extremes. Days are cut into blocks of ``k``, so a frame is the end
  of one block and the start of the next. Both are running aggregates, one in each
  direction, and two such summaries merge; nothing is ever subtracted, so a large
  value leaves no trace once it has left the frame. Which end of the last block
  a row needs is found by a running ``last`` over events: a row takes effect
  ``k`` days after the row before it, when that one leaves the frame.
* Rolling quantiles. The values of a slice are one array; a frame is a stretch of
  it whose ends come from running counts, sorted once for all its quantiles.
* Expanding quantiles. Runs of values in order; of all the runs before it a
  run keeps only the few values around each quantile that its own rows can reach, with
  the rank at which they begin.

Frames are taken in slices of time, copied with the longest frame before them and
distributed by (asset, slice): tasks follow rows, not assets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.stats import unbiased_kurtosis, unbiased_skewness
from tideline.operators.panel import by_time
from tideline.operators.returns import cumulative_return, daily_returns, horizons, lagged_returns

#: Days of a slice, beside the longest frame that is copied in front of it.
SLICE_DAYS = 1826
#: Values of one run of the expanding quantiles.
RUN = 64

KEYS = ("asset",)


class MeanFrame(NamedTuple):
    """Output column for the mean of one column and frame."""

    column: str
    days: int
    output: str


class ShapeFrame(NamedTuple):
    """Statistics of one column and frame.

    ``outputs`` maps an output column to ``("quantile", p)``,
    ``("spread", low, high)`` - the difference of two quantiles, where 0 and 1
    are the extremes - ``("mean",)``, ``("std",)``, ``("skew",)`` or ``("kurt",)``.
    """

    column: str
    days: int
    outputs: Mapping[str, tuple]


def rolling_mean(df: DataFrame, frames: Sequence[MeanFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add rolling means."""
    wanted = [ShapeFrame(f.column, f.days, {f.output: ("mean",)}) for f in frames]
    return shape_statistics(df, wanted, keys)


def _summary(x: str, over: Window, kinds: set[str]) -> list[Column]:
    """Running aggregates of a column that the wanted statistics need."""
    made = {"n": F.count(x)}
    if kinds != {"spread"}:
        made["mean"] = F.avg(x)
    if kinds & {"std", "skew", "kurt"}:
        made["var"] = F.var_pop(x)
    if kinds & {"skew", "kurt"}:
        made["skew"] = F.skewness(x)
    if "kurt" in kinds:
        made["kurt"] = F.kurtosis(x)
    if kinds != {"mean"}:
        made |= {"low": F.min(x), "high": F.max(x)}
    return [c.over(over).alias(name) for name, c in made.items()]


def _merged(df: DataFrame, kinds: set[str]) -> DataFrame:
    """Add the summary ``_n, _mean, _low, _high, _m2, _m3, _m4`` of the values in ``_end`` and ``_start`` together.

    ``_m2`` to ``_m4`` are sums of powers about the mean, 0 for no value and for equal ones.
    """
    columns = {"_x": "coalesce(_end.n, 0) * 1d", "_y": "_start.n * 1d"}
    if kinds != {"mean"}:
        columns |= {"_low": "least(_end.low, _start.low)", "_high": "greatest(_end.high, _start.high)"}
    for tag, s in (("a", "_end"), ("b", "_start")):
        if kinds & {"std", "skew", "kurt"}:
            columns[f"_{tag}2"] = f"coalesce({s}.var * {s}.n, 0d)"
        if kinds & {"skew", "kurt"}:
            columns[f"_{tag}3"] = f"coalesce({s}.skew * {s}.var * sqrt({s}.var) * {s}.n, 0d)"
        if "kurt" in kinds:
            columns[f"_{tag}4"] = f"coalesce(({s}.kurt + 3) * {s}.var * {s}.var * {s}.n, 0d)"
    if kinds != {"spread"}:
        # An empty part takes the other's mean, so that it adds nothing.
        columns |= {"_ma": "coalesce(_end.mean, _start.mean)", "_mb": "coalesce(_start.mean, _end.mean)"}
    df = df.selectExpr("*", "nullif(coalesce(_end.n, 0) + _start.n, 0) * 1d as _n", *(f"{c} as {name}" for name, c in columns.items()))
    if kinds == {"spread"}:
        return df
    df = df.selectExpr("*", "(_x * _ma + _y * _mb) / _n as _mean", "_mb - _ma as _d", "_x * _y / _n as _t")
    made = []
    if kinds & {"std", "skew", "kurt"}:
        made.append("_a2 + _b2 + _d * _d * _t as _m2")
    if kinds & {"skew", "kurt"}:
        made.append("_a3 + _b3 + _d * (_d * _d * _t * (_x - _y) + 3 * (_x * _b2 - _y * _a2)) / _n as _m3")
    if "kurt" in kinds:
        fourth = "_d * _d * _t * (_x * _x - _x * _y + _y * _y) + 6 * (_x * _x * _b2 + _y * _y * _a2)"
        made.append(f"_a4 + _b4 + _d * (_d * ({fourth}) / (_n * _n) + 4 * (_x * _b3 - _y * _a3) / _n) as _m4")
    return df.selectExpr("*", *made) if made else df


def _statistic(how: tuple) -> str:
    """One statistic of a merged summary. Frames of equal values have a std of 0 and no shape."""
    if how == ("mean",):
        return "_mean"
    if how == ("spread", 0, 1):
        return "_high - _low"
    if how == ("std",):
        return "if(_n >= 2, if(_low < _high, sqrt(_m2 / (_n - 1)), 0d), null)"
    if how == ("skew",):
        return "if(_n >= 3 and _low < _high and _m2 > 0, _n * sqrt(_n - 1) / (_n - 2) * _m3 / (_m2 * sqrt(_m2)), null)"
    excess = "(_n * _m4 / (_m2 * _m2) - 3)"
    unbiased = f"(_n - 1) / ((_n - 2) * (_n - 3)) * ((_n + 1) * {excess} + 6)"
    return f"if(_n >= 4 and _low < _high and _m2 > 0, {unbiased}, null)"


def _by_rank(frame: Mapping[str, tuple]) -> dict[str, tuple]:
    return {name: how for name, how in frame.items() if how[0] == "quantile" or (how[0] == "spread" and how[1:] != (0, 1))}


def _block_statistics(df: DataFrame, frames: Sequence[ShapeFrame], keys: Sequence[str]) -> DataFrame:
    """Moments and extremes of all frames from block summaries, as one row per frame in between."""
    kinds = {how[0] for f in frames for how in f.outputs.values()}
    rows = df.select(*keys, "n", F.struct("*").alias("_all")).withColumn("_before", F.lag("n").over(by_time(*keys)))
    # The first of a row's frames carries its columns.
    each = ", ".join(
        f"named_struct('_k', {k}, '_days', {f.days}, '_v', _all.`{f.column}`, '_own', if({k} = 0, _all, null))"
        for k, f in enumerate(frames)
    )
    rows = rows.selectExpr(*keys, "n", "_before", f"explode(array({each})) as _f")
    rows = rows.selectExpr(*keys, "n", "_before", "_f.*", "floor(n / _f._days) as _block")
    blocks = Window.partitionBy(*keys, "_k", "_block").rowsBetween(Window.unboundedPreceding, 0)
    start = F.struct("_block", *_summary("_v", blocks.orderBy("n"), kinds))
    end = F.struct("_block", *_summary("_v", blocks.orderBy(F.desc("n")), kinds))
    # The end of its block from this row on counts from the day on which the row before has left the frame.
    since = F.coalesce(F.col("_before") + F.col("_days"), F.col("n")).cast(df.schema["n"].dataType)
    rows = rows.select(*keys, "_k", "n", since.alias("_since"), "_own", start.alias("_start"), end.alias("_end"))
    nothing = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    both = F.array(
        F.struct("n", F.lit(1).alias("_row"), "_own", "_start", nothing("_end")),
        F.struct(F.col("_since").alias("n"), F.lit(0).alias("_row"), nothing("_own"), nothing("_start"), "_end"),
    )
    rows = rows.select(*keys, "_k", F.explode(both).alias("_event")).select(*keys, "_k", "_event.*")
    latest = Window.partitionBy(*keys, "_k").orderBy("n", "_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.last("_end", ignorenulls=True).over(latest)).where("_row = 1")
    # A frame may begin in the row's own block, whose start covers it then.
    rows = rows.withColumn("_end", F.when(F.col("_end._block") == F.col("_start._block") - 1, F.col("_end")))
    hows = list(dict.fromkeys(how for f in frames for how in f.outputs.values()))
    merged = _merged(rows, kinds).selectExpr(*keys, "n", "_k", "_own", *(f"{_statistic(how)} as _o{i}" for i, how in enumerate(hows)))
    found = [
        F.expr(f"max(if(_k = {k}, _o{hows.index(how)}, null)) as `{name}`") for k, f in enumerate(frames) for name, how in f.outputs.items()
    ]
    wide = merged.groupBy(*keys, "n").agg(F.first("_own", ignorenulls=True).alias("_own"), *found)
    return wide.selectExpr("_own.*", *(f"`{name}`" for f in frames for name in f.outputs))


def _interpolated(ordered: str, n: str, p: float, below: str = "0") -> str:
    """The quantile of ``n`` values of which an array holds those of rank ``below`` and up."""
    place = f"({p!r}d * ({n} - 1))"
    at = f"cast(floor({place}) as int)"
    low, high = f"get({ordered}, {at} - {below})", f"get({ordered}, {at} - {below} + 1)"
    return f"if({n} > 0, {low} + (coalesce({high}, {low}) - {low}) * ({place} - {at}), null)"


def _ranked(how: tuple, quantile: Callable[[float], str]) -> str:
    """A quantile or the difference of two."""
    return quantile(how[1]) if how[0] == "quantile" else f"{quantile(how[2])} - {quantile(how[1])}"


def _rank_statistics(df: DataFrame, frames: Sequence[ShapeFrame], keys: Sequence[str]) -> DataFrame:
    """Quantiles of every frame from stretches of the slice's values."""
    time = by_time(*keys)
    whole = time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = time.rowsBetween(Window.unboundedPreceding, 0)
    found, ordered, made = [], [], []
    for k, f in enumerate(frames):
        gone = F.count(f.column).over(time.rangeBetween(Window.unboundedPreceding, -f.days))
        found += [F.collect_list(f.column).over(whole).alias(f"_v{k}"), gone.alias(f"_g{k}"), F.count(f.column).over(upto).alias(f"_h{k}")]
        ordered += [
            f"sort_array(slice(_v{k}, cast(_g{k} + 1 as int), cast(_h{k} - _g{k} as int))) as _s{k}", f"cast(_h{k} - _g{k} as int) as _n{k}",
        ]
        quantile = lambda p, k=k: _interpolated(f"_s{k}", f"_n{k}", p)
        made += [f"{_ranked(how, quantile)} as `{name}`" for name, how in f.outputs.items()]
    raw = df.select("*", *found)
    names = [f"`{c}`" for c in df.columns]
    return raw.selectExpr(*names, *ordered).selectExpr(*names, *made)


def shape_statistics(df: DataFrame, frames: Sequence[ShapeFrame], keys: Sequence[str] = KEYS, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Add exact rolling quantiles, spreads, means and bias-corrected shape moments.

    Rows are one per key and day number ``n``; days may be missing.
    """
    ranked = [f._replace(outputs=_by_rank(f.outputs)) for f in frames]
    others = [f._replace(outputs={k: v for k, v in f.outputs.items() if k not in r.outputs}) for f, r in zip(frames, ranked)]
    names = [name for f in frames for name in f.outputs]

    def step(sliced: DataFrame, own: Sequence[str]) -> DataFrame:
        by_block, by_rank = ([f for f in part if f.outputs] for part in (others, ranked))
        sliced = _block_statistics(sliced, by_block, own) if by_block else sliced
        return _rank_statistics(sliced, by_rank, own) if by_rank else sliced

    return in_slices(df, max(f.days for f in frames), slice_days, step, keys).select(*df.columns, *names)


def in_slices(
    df: DataFrame,
    halo_days: int,
    slice_days: int,
    step: Callable[[DataFrame, Sequence[str]], DataFrame],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Run a rolling step on time slices of each series instead of whole series.

    Parallelism then follows the data instead of the number of assets. Every row is
    copied into the later slices whose frames reach back to it (``halo_days`` is the
    longest frame), and the copies are dropped afterwards.
    """
    own = F.floor(F.col("n") / slice_days).cast("int")
    last = F.floor((F.col("n") + halo_days - 1) / slice_days).cast("int")
    name = f"_slice{len(keys)}"
    copies = df.withColumn(name, F.explode(F.sequence(own, last))).repartition(*keys, name)
    return step(copies, (*keys, name)).where(F.col(name) == own).drop(name)


def return_mean_frames(lags: Mapping[str, int]) -> list[MeanFrame]:
    """The ``SMA`` columns of the feature table."""
    return [MeanFrame(f"Return_{h}", days, f"SMA_{h}_Return") for h, days in lags.items()]


SHAPE_FAMILIES = {
    "std": {"STD_{}_Return": ("std",)},
    "quantile": {f"Quantile_{{}}_{round(p * 100)}": ("quantile", p) for p in (0.1, 0.5, 0.9)},
    "iqr": {"IQR_{}": ("spread", 0.25, 0.75)},
    "skew": {"Skew_{}": ("skew",)},
    "kurtosis": {"Kurtosis_{}": ("kurt",)},
    "range": {"Range_{}": ("spread", 0, 1)},
}


def _together(frames: Sequence[ShapeFrame]) -> list[ShapeFrame]:
    """Frames of the same column and length as one."""
    outputs: dict[tuple[str, int], dict[str, tuple]] = {}
    for f in frames:
        outputs.setdefault((f.column, f.days), {}).update(f.outputs)
    return [ShapeFrame(column, days, wanted) for (column, days), wanted in outputs.items()]


def return_shape_frames(
    lags: Mapping[str, int], families: Sequence[str] = tuple(SHAPE_FAMILIES), std_5yr_horizon: str = "3yr"
) -> list[ShapeFrame]:
    """The std, quantile, interquartile-range, skewness, kurtosis and range columns of the feature table.

    ``STD_5yr_Return`` measures the five-year return over the three-year frame
    by default, as the original study does.
    """
    outputs: dict[tuple[str, int], dict[str, tuple]] = {}
    for h, days in lags.items():
        for family in families:
            shifted = family == "std" and h == "5yr"
            frame = outputs.setdefault((f"Return_{h}", lags.get(std_5yr_horizon, days) if shifted else days), {})
            frame |= {name.format(h): how for name, how in SHAPE_FAMILIES[family].items()}
    return [ShapeFrame(column, days, wanted) for (column, days), wanted in outputs.items()]


EXPANDING_QUANTILES = {
    "Cum_Quantile_10": ("quantile", 0.1),
    "Cum_Quantile_50": ("quantile", 0.5),
    "Cum_Quantile_90": ("quantile", 0.9),
    "Cum_IQR": ("spread", 0.25, 0.75),
}


def expanding_moments(returns: DataFrame, value: str = "r", keys: Sequence[str] = KEYS) -> DataFrame:
    """Std, range, skewness and kurtosis of all returns so far (incremental frames)."""
    upto = by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    return returns.withColumns(
        {
            "Cum_STD": F.stddev_samp(x).over(upto),
            "Cum_Range": F.max(x).over(upto) - F.min(x).over(upto),
            "Cum_Skew": unbiased_skewness(x, upto),
            "Cum_Kurtosis": unbiased_kurtosis(x, upto),
        }
    )


def expanding_quantiles(
    returns: DataFrame,
    value: str = "r",
    outputs: Mapping[str, tuple] = EXPANDING_QUANTILES,
    keys: Sequence[str] = KEYS,
    run: int = RUN,
) -> DataFrame:
    """Add exact quantiles of all values so far (NULL before the first).

    A row in a run of ``run`` values moves a quantile by at most as many ranks, so
    of the sorted values before the run about ``3 * run`` around each quantile decide.
    """
    time = by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)
    levels = sorted({p for how in outputs.values() for p in how[1:]})
    counted = returns.withColumn("_n", F.count(value).over(time).cast("int"))
    counted = counted.withColumn("_run", F.floor((F.greatest(F.col("_n"), F.lit(1)) - 1) / run).cast("int"))
    values = counted.where(F.col(value).isNotNull()).groupBy(*keys, "_run")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("n", F.col(value).alias("v")))), lambda x: x["v"])
    runs = values.agg(in_order.alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_past", F.sort_array(F.flatten(F.collect_list("_own").over(earlier))))
    # Values before the first that is kept; one more on either side takes part in the interpolation.
    below = [f"greatest(cast(floor({p!r}d * (size(_past) - 1)) as int) - {run + 1}, 0)" for p in levels]
    near = [f"named_struct('below', {b}, 'values', slice(_past, {b} + 1, {3 * run + 4})) as _near{k}" for k, b in enumerate(below)]
    rows = counted.join(runs.selectExpr(*keys, "_run", "_own", *near), [*keys, "_run"], "left")
    since = f"slice(_own, 1, greatest(_n - _run * {run}, 0))"
    rows = rows.selectExpr("*", *(f"sort_array(concat(_near{k}.values, {since})) as _sorted{k}" for k in range(len(levels))))

    def quantile(p: float) -> str:
        k = levels.index(p)
        return _interpolated(f"_sorted{k}", "_n", p, f"_near{k}.below")

    return rows.selectExpr(*(f"`{c}`" for c in returns.columns), *(f"{_ranked(how, quantile)} as `{name}`" for name, how in outputs.items()))


def feature_columns(lags: Mapping[str, int] | None = None) -> list[str]:
    """Names of the derived columns, grouped by family (69 for the six horizons)."""
    hs = list(lags or horizons())
    per_horizon = [
        "Return_{}", "SMA_{}_Return", "STD_{}_Return", "Quantile_{}_10", "Quantile_{}_50", "Quantile_{}_90",
        "IQR_{}", "Skew_{}", "Kurtosis_{}", "Range_{}",
    ]
    expanding = ["Return", "STD", "Quantile_10", "Quantile_50", "Quantile_90", "IQR", "Range", "Skew", "Kurtosis"]
    return [name.format(h) for name in per_horizon for h in hs] + [f"Cum_{name}" for name in expanding]


def extract_features(panel: DataFrame, trading_days: int = 252, std_5yr_horizon: str = "3yr") -> DataFrame:
    """The full feature table: price plus 69 return and risk columns per asset and day."""
    lags = horizons(trading_days)
    base = lagged_returns(cumulative_return(daily_returns(panel)), lags)
    means = [ShapeFrame(f.column, f.days, {f.output: ("mean",)}) for f in return_mean_frames(lags)]
    frames = [*means, *return_shape_frames(lags, std_5yr_horizon=std_5yr_horizon)]
    shaped = shape_statistics(expanding_moments(base).drop("px"), _together(frames))
    return expanding_quantiles(shaped).select("asset", "date", "price", *feature_columns(lags))
