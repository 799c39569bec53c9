"""The same results in plain SQL, written from the definitions.

Windows are spelled directly over the whole history, covariances come from
self joins and as-of estimates rescan the past: slow but independent of how the
Spark side computes them.
"""

from __future__ import annotations

from tideline.operators.returns import horizons
from tideline.operators.rolling import feature_columns
from tideline.plans.queries import COV_PERIODS, PORTFOLIOS, PUBLISHED_WEIGHTS
from tideline.sources.star import MARKETS, PANEL_END, PANEL_START

# Money is summed in whole cents, so prices are the same bits whatever the row order.
PRICE = "cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (sum(l_quantity) * 100)"

BASE = f"""
obs as (
  select r_name || '_' || l_linestatus as asset, cast(l_shipdate as date) as date,
         {PRICE} as price, min(l_orderkey) as seq
  from lineitem
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  group by 1, 2),
cal as (
  select cast(t.d as date) as date, row_number() over (order by t.d) as k
  from range(date '{PANEL_START}', date '{PANEL_END}' + 1, interval 1 day) t(d)
  where isodow(t.d) < 6),
p as (
  select a.asset, cal.date, cal.k, o.price
  from (select distinct asset from obs) a cross join cal
  left join obs o on o.asset = a.asset and o.date = cal.date),
f as (
  select asset, date, k, price, last_value(price ignore nulls) over
    (partition by asset order by date rows between unbounded preceding and current row) as px
  from p),
r as (
  select asset, date, k, price, px, px / lag(px) over (partition by asset order by date) - 1 as r
  from f)"""


def rnd(expr: str, digits: int = 4) -> str:
    """Rounded, without negative zeros."""
    return f"case when round({expr}, {digits}) = 0 then 0.0 else round({expr}, {digits}) end"


def even(expr: str, digits: int = 2) -> str:
    return f"case when round_even({expr}, {digits}) = 0 then 0.0 else round_even({expr}, {digits}) end"


def day(expr: str = "date") -> str:
    return f"cast(cast({expr} as date) as varchar)"


def sql(select: str, *ctes: str) -> str:
    return "with " + ",\n".join([BASE, *ctes]) + "\n" + select


def lagged(days: dict[str, int]) -> str:
    def one(h: str, k: int) -> str:
        frame = f"range between interval {k} days preceding and interval {k} days preceding"
        return f'(px / max(px) over (partition by asset order by date {frame}) - 1) * 100 as "Return_{h}"'

    return "l as (select *, " + ", ".join(one(h, k) for h, k in days.items()) + " from r)"


DAYS = horizons()
LAGGED = lagged(DAYS)


def over(days: int) -> str:
    return (
        f"over (partition by asset order by date range between interval {days - 1} days preceding and current row)"
    )


SO_FAR = "over (partition by asset order by date rows between unbounded preceding and current row)"


def feature(name: str) -> str:
    """SQL expression of one feature column."""
    if name.startswith("Cum_"):
        kind = name.removeprefix("Cum_")
        if kind == "Return":
            return f"(product(1 + r) {SO_FAR} - 1) * 100"
        x, w, rest = "r", SO_FAR, kind
    else:
        h = next(part for part in name.split("_") if part in DAYS)
        if name.startswith("Return_"):
            return f'"{name}"'
        x, w, rest = f'"Return_{h}"', over(756 if name == "STD_5yr_Return" else DAYS[h]), name
    if rest.startswith("SMA"):
        return f"avg({x}) {w}"
    if rest.startswith("STD"):
        return f"stddev_samp({x}) {w}"
    if rest.startswith("Quantile"):
        return f"quantile_cont({x}, {int(rest[-2:]) / 100}) {w}"
    if rest.startswith("IQR"):
        return f"quantile_cont({x}, 0.75) {w} - quantile_cont({x}, 0.25) {w}"
    if rest.startswith("Range"):
        return f"max({x}) {w} - min({x}) {w}"
    return f"{'skewness' if rest.startswith('Skew') else 'kurtosis'}({x}) {w}"


def features(columns: list[str], *extra: str) -> str:
    cols = ", ".join(f'{rnd(feature(c))} as "{c}"' for c in columns)
    return sql(f"select asset, {day()} as date, {''.join(e + ', ' for e in extra)}{cols} from l", LAGGED)


def wide(source: str, value: str, digits: int | None = None) -> str:
    cells = {a: f"max(case when asset = '{a}' then {value} end)" for a in MARKETS}
    cols = ", ".join(f'{cell if digits is None else rnd(cell, digits)} as "{a}"' for a, cell in cells.items())
    return f"select {day()} as date, {cols} from {source} group by {source}.date"


PAIRS = "from r a join r b on a.date = b.date group by a.asset, b.asset"
SAMPLE_COV = f"cov as (select a.asset as i, b.asset as j, covar_samp(a.r, b.r) * 252 as cov {PAIRS})"
CORR = """corr as (
  select c.i, c.j, c.cov / sqrt(d.cov * e.cov) as corr
  from cov c join cov d on d.i = c.i and d.j = c.i join cov e on e.i = c.j and e.j = c.j)"""


def ledoit_wolf(source: str, keys: str = "") -> str:
    """CTEs ending in ``lw(keys, i, j, cov, delta)`` for complete rows ``source(keys, asset, date, r)``."""
    k = f"{keys}, " if keys else ""
    ak = f"a.{keys}, " if keys else ""
    on = f"a.date = b.date and a.{keys} = b.{keys}" if keys else "a.date = b.date"
    match = f"x.{keys} = y.{keys}" if keys else "true"
    return f"""
lw_c as (select {k}asset, date, r - avg(r) over (partition by {k}asset) as z from {source}),
lw_p as (
  select {ak}a.asset as i, b.asset as j, count(*) as t, covar_samp(a.z, b.z) as s,
         var_samp(a.z) as vi, var_samp(b.z) as vj, avg(a.z * b.z) as h, avg(a.z * a.z) as hi,
         avg(a.z * a.z * b.z * b.z) as m22, avg(a.z * a.z * a.z * b.z) as m31
  from lw_c a join lw_c b on {on} group by {ak}a.asset, b.asset having count(*) >= 2),
lw_r as (select {k}avg(s / sqrt(vi * vj)) as rbar from lw_p where i <> j {'group by ' + keys if keys else ''}),
lw_d as (
  select {'x.' + keys + ', ' if keys else ''}any_value(rbar) as rbar, greatest(0, least(1,
    sum((m22 - 2 * h * s + s * s) - rbar * sqrt(vj / vi) * (m31 - hi * s - h * vi + vi * s))
    / sum((s - rbar * sqrt(vi * vj)) * (s - rbar * sqrt(vi * vj))) / max(t))) as delta
  from lw_p x join lw_r y on {match} where i <> j {'group by x.' + keys if keys else ''}),
lw as (
  select {'x.' + keys + ', ' if keys else ''}i, j,
    (delta * case when i = j then s else rbar * sqrt(vi * vj) end + (1 - delta) * s) * 252 as cov, delta
  from lw_p x join lw_d y on {match})"""


COMPLETE = "full_days as (select date from r group by date having count(r) = count(*)), rc as (select asset, date, r from r where date in (select date from full_days))"
LW = COMPLETE + "," + ledoit_wolf("rc")
DECAY = "power(1 - 2.0 / 501.0, {})"
MU = f"""mu as (
  select asset, sum(r * w) / sum(case when r is not null then w end) * 252 as mu
  from (select asset, r, {DECAY.format("(select max(k) from cal) - k")} as w from r) group by asset)"""


def candidates(key: str, mu: str, cov: str) -> str:
    return f"""
shares as (select unnest(range(1, 21)) / 20.0 as w),
cand as (
  select c.{key}, c.i, c.j, w, w * m.mu + (1 - w) * n.mu as ret,
         sqrt(w * w * d.cov + (1 - w) * (1 - w) * e.cov + 2 * w * (1 - w) * c.cov) as vol
  from {cov} c
  join {cov} d on d.{key} = c.{key} and d.i = c.i and d.j = c.i
  join {cov} e on e.{key} = c.{key} and e.i = c.j and e.j = c.j
  join {mu} m on m.{key} = c.{key} and m.asset = c.i
  join {mu} n on n.{key} = c.{key} and n.asset = c.j
  join shares on (c.i < c.j and w < 1) or (c.i = c.j and w = 1)),
scored as (select *, (ret - 0.02) / vol as sharpe from cand),
best as (
  select * exclude (a, b), case when a = 1 then 'max_sharpe' end as pa, case when b = 1 then 'min_vol' end as pb from (
    select *, row_number() over (partition by {key} order by sharpe desc, i, j, w) as a,
              row_number() over (partition by {key} order by vol, i, j, w) as b from scored)
  where a = 1 or b = 1),
chosen as (
  select {key}, pa as portfolio, i, j, w, ret, vol, sharpe from best where pa is not null
  union all select {key}, pb, i, j, w, ret, vol, sharpe from best where pb is not null)"""


UNIVERSE = """
umu as (select split_part(asset, '_', 2) as universe, asset, mu from mu),
ucov as (select split_part(i, '_', 2) as universe, i, j, cov from lw where split_part(i, '_', 2) = split_part(j, '_', 2))"""
UNIVERSE_CANDIDATES = [LW, MU, UNIVERSE, candidates("universe", "umu", "ucov")]

_VALUES = ", ".join(
    f"('{p}', '{a}', cast({w} as double))" for p, ws in PUBLISHED_WEIGHTS.items() for a, w in zip(MARKETS, ws)
)
WEIGHTS = f"""
published(portfolio, asset, weight) as (values {_VALUES}),
w as (select * from published union all
      select 'equal_wt', asset, 1.0 / (select count(distinct asset) from published) from (select distinct asset from published)),
v as (
  select portfolio, date, sum(price * weight) as value
  from p join w using (asset) group by portfolio, date having count(price) = count(*))"""

# Period means of the portfolio values with the empty periods in between, then padded returns.
_LABEL = {
    "monthly": "last_day(date)",
    "quarterly": "last_day(cast(date_trunc('quarter', date) as date) + interval 2 month)",
    "annual": "make_date(year(date), 12, 31)",
}


def period_returns(source: str, key: str, value: str, freqs: list[str]) -> str:
    blocks, grids = [], []
    for freq in freqs:
        if freq == "daily":
            blocks.append(f"select {key}, 'daily' as freq, date as label, {value} as v from {source} where {value} is not null")
            grids.append(f"select {key}, 'daily' as freq, date as label from {source} where {value} is not null")
            continue
        label = f"cast({_LABEL[freq]} as date)"
        blocks.append(
            f"select {key}, '{freq}' as freq, {label} as label, avg({value}) as v from {source} where {value} is not null group by {key}, {label}"
        )
        grids.append(
            f"""select b.{key}, '{freq}' as freq, c.label from
            (select {key}, min({label}) as lo, max({label}) as hi from {source} where {value} is not null group by {key}) b
            join (select distinct {label} as label from cal) c on c.label between b.lo and b.hi"""
        )
    return f"""
pm as ({' union all '.join(blocks)}),
pg as ({' union all '.join(grids)}),
pf as (
  select {key}, freq, label, last_value(v ignore nulls) over
    (partition by {key}, freq order by label rows between unbounded preceding and current row) as v
  from pg left join pm using ({key}, freq, label)),
pr as (select {key}, freq, label, v / lag(v) over (partition by {key}, freq order by label) - 1 as r from pf)"""


FREQS = ["daily", "monthly", "quarterly", "annual"]
PORTFOLIO_RETURNS = period_returns("v", "portfolio", "value", FREQS)


def histogram(source: str, keys: str, bins: str) -> str:
    on = " and ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    yk = ", ".join(f"y.{k.strip()}" for k in keys.split(","))
    return f"""
hb as (
  select {keys}, case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi, nb
  from (select {keys}, min(r) as lo, max(r) as hi, {bins} as nb from {source} where r is not null group by {keys})),
hc as (
  select {xk}, least(cast(floor((r - lo) / (hi - lo) * nb) as integer), nb - 1) as bin, count(*) as frequency
  from {source} x join hb y on {on} where r is not null group by all),
hg as (select {keys}, lo, hi, nb, unnest(range(0, nb)) as bin from hb),
h as (
  select {yk}, y.bin, lo + y.bin * (hi - lo) / nb as lower, lo + (y.bin + 1) * (hi - lo) / nb as upper,
         coalesce(x.frequency, 0) as frequency
  from hg y left join hc x on {on} and x.bin = y.bin)"""


STATS = f"""count(r) as n_returns, {even('avg(r * 100)')} as mean, {even('median(r * 100)')} as median,
{even('stddev_samp(r * 100)')} as std, {even('skewness(r)')} as skew, {even('kurtosis(r)')} as kurtosis"""

ASOF = f"""
reb as (select max(date) as rebalance_date, max(k) as rk from cal group by year(date), quarter(date)),
asof_mu as (
  select rebalance_date, asset, sum(r * w) / sum(w) * 252 as mu from (
    select rebalance_date, asset, r, {DECAY.format("rk - k")} as w
    from r join reb on r.date <= reb.rebalance_date where r is not null)
  group by rebalance_date, asset)"""
ASOF_COV = (
    COMPLETE
    + ", asof_r as (select rebalance_date, asset, date, r from rc join reb on rc.date <= reb.rebalance_date),"
    + ledoit_wolf("asof_r", "rebalance_date")
)
ASOF_WEIGHTS = candidates("rebalance_date", "asof_mu", "lw") + """,
cw as (
  select rebalance_date, portfolio, asset, sum(weight) as weight from (
    select rebalance_date, portfolio, i as asset, w as weight from chosen
    union all select rebalance_date, portfolio, j, 1 - w from chosen where i <> j) group by all),
rd as (
  select portfolio, rebalance_date, lead(rebalance_date) over (partition by portfolio order by rebalance_date) as nxt
  from (select distinct portfolio, rebalance_date from cw))"""


def _weekly_cov() -> str:
    cases = " ".join(f"when year(date) between {lo} and {hi} then '{n}'" for n, (lo, hi) in COV_PERIODS.items())
    return sql(
        f"""select a.period, a.asset as i, b.asset as j, {rnd('covar_samp(a.r, b.r) * 252')} as cov
        from wc a join wc b on a.period = b.period and a.week = b.week group by a.period, a.asset, b.asset""",
        f"""wk as (select case {cases} end as period, asset, date_trunc('week', date) as week, avg(r) as r
                   from r group by 1, 2, 3),
        wd as (select period, week from wk group by period, week having count(r) = count(*)),
        wc as (select wk.* from wk join wd on wk.period = wd.period and wk.week = wd.week where wk.period is not null)""",
    )


def oracle_sql() -> dict[str, str]:
    hs = list(DAYS)
    q: dict[str, str] = {}
    q["unpivot_pairs"] = sql(f"select asset, {day()} as date, price from obs")
    q["business_calendar"] = f"""
        select {day('t.d')} as date from (
          select unnest(range(lo, hi + 1, interval 1 day)) as d from
          (select cast(min(l_shipdate) as date) as lo, cast(max(l_shipdate) as date) as hi from lineitem)) t
        where isodow(t.d) < 6"""
    q["clean_prices"] = sql(f"select asset, {day()} as date, price from p")
    q["ffill_prices"] = sql(f"select asset, {day()} as date, px from f")
    q["series_quality"] = sql(
        f"""select asset, count(*) as n_rows, count(*) - count(price) as n_null,
            count(*) filter (isodow(date) > 5) as n_off_calendar, {day('min(date)')} as first_date,
            {day('max(date)')} as last_date, count(*) - count(distinct date) as n_duplicate,
            count(*) filter (date < prev) as n_backward, count(*) filter (date < prev) = 0 as is_monotonic
            from (select *, lag(date) over (partition by asset order by seq, date) as prev from obs) group by asset"""
    )
    q["asset_subset"] = sql(
        f"select asset, {day()} as date, price from p where asset in ('{MARKETS[0]}', '{MARKETS[9]}')"
    )
    q["panel_wide"] = sql(wide("p", "price"))
    q["panel_tail"] = sql(wide("p", "price") + " order by p.date desc limit 5")
    q["complete_case"] = sql(
        f"""select asset, {day()} as date, price from p
        where date in (select date from p group by date having count(price) = count(*))"""
    )

    q["daily_returns"] = sql(f"select asset, {day()} as date, {rnd('r', 6)} as r from r")
    q["returns_wide"] = sql(wide("r", "r", 6))
    cols = ", ".join(f'{rnd(chr(34) + "Return_" + h + chr(34))} as "Return_{h}"' for h in hs)
    for name, days in (("lagged_returns", DAYS), ("lagged_returns_360", horizons(360))):
        q[name] = sql(f"select asset, {day()} as date, {cols} from l", lagged(days))
    q["cumulative_return"] = sql(f"select asset, {day()} as date, {rnd(feature('Cum_Return'))} as \"Cum_Return\" from r")
    q["multi_period_return"] = sql(
        f"""select asset, year(date) as year, {rnd('coalesce(product(1 + r), 1) - 1')} as total_return
        from r group by 1, 2"""
    )

    q["rolling_mean"] = features([f"SMA_{h}_Return" for h in hs])
    q["rolling_std"] = features([f"STD_{h}_Return" for h in hs])
    q["rolling_quantiles"] = features([f"Quantile_{h}_{p}" for h in hs for p in (10, 50, 90)])
    for key, family in (("iqr", "IQR"), ("skew", "Skew"), ("kurtosis", "Kurtosis"), ("range", "Range")):
        q[f"rolling_{key}"] = features([f"{family}_{h}" for h in hs])
    q["expanding_moments"] = features(["Cum_STD", "Cum_Range", "Cum_Skew", "Cum_Kurtosis"])
    q["expanding_quantiles"] = features(["Cum_Quantile_10", "Cum_Quantile_50", "Cum_Quantile_90", "Cum_IQR"])
    q["feature_table"] = features(feature_columns(), "price")

    week = "cast(date_trunc('week', date) as date) + 6"
    q["resample_week"] = sql(f"select asset, {day(week)} as date, {rnd('avg(r)', 6)} as mean_return from r group by 1, 2")
    for key, freq in (("month", "monthly"), ("quarter", "quarterly")):
        q[f"resample_{key}"] = sql(
            f"select asset, {day(_LABEL[freq])} as date, {rnd('avg(price)')} as mean_price from p group by 1, 2"
        )
    q["resample_year"] = sql(
        f"""select asset, {day(_LABEL['annual'])} as date, {rnd('avg(price)', 6)} as mean_price,
        {rnd('avg(r)', 6)} as mean_return, {rnd('stddev_samp(r)', 6)} as std_return from r group by 1, 2"""
    )

    q["cov_sample"] = sql(f"select i, j, {rnd('cov')} as cov from cov", SAMPLE_COV)
    q["cov_suppliers"] = f"""
        with so as (
          select printf('S%08d', l_suppkey) as asset, cast(l_shipdate as date) as date, {PRICE} as price
          from lineitem group by 1, 2),
        sc as (select cast(t.d as date) as date from range(date '{PANEL_START}', date '{PANEL_END}' + 1, interval 1 day) t(d)
               where isodow(t.d) < 6),
        sp as (select a.asset, sc.date, o.price from (select distinct asset from so) a cross join sc
               left join so o on o.asset = a.asset and o.date = sc.date),
        sx as (select asset, date, last_value(price ignore nulls) over
               (partition by asset order by date rows between unbounded preceding and current row) as px from sp),
        sr as (select asset, date, px / lag(px) over (partition by asset order by date) - 1 as r from sx)
        select a.asset as i, b.asset as j, {rnd('covar_samp(a.r, b.r) * 252', 2)} as cov
        from sr a join sr b on a.date = b.date group by a.asset, b.asset"""
    q["correlation"] = sql(f"select i, j, {rnd('corr')} as corr from corr", SAMPLE_COV, CORR)
    q["near_duplicates"] = sql(
        f"select i, j, {rnd('corr')} as corr from corr where i < j and corr >= 0.05", SAMPLE_COV, CORR
    )
    q["cov_by_period"] = _weekly_cov()
    q["cov_ewm"] = sql(
        f"""select a.asset as i, b.asset as j,
            {rnd("sum(a.z * b.z * a.w) / sum(case when a.z * b.z is not null then a.w end) * 252")} as cov
        from z a join z b on a.date = b.date group by a.asset, b.asset""",
        """z as (select asset, date, r - avg(r) over (partition by asset) as z,
                 power(1 - 2.0 / 181.0, (select max(k) from cal) - k) as w from r)""",
    )
    q["cov_ledoit_wolf"] = sql(f"select i, j, {rnd('cov')} as cov, {rnd('delta')} as delta from lw", LW)
    q["mu_ewm"] = sql(f"select asset, {rnd('mu')} as mu from mu", MU)

    q["weights_table"] = sql(
        f"""select a.asset, {rnd('a.weight', 5)} as max_sharpe, {rnd('b.weight', 5)} as min_vol, o.n_prices
        from published a join published b on a.asset = b.asset
        join (select asset, count(price) as n_prices from obs group by asset) o on o.asset = a.asset
        where a.portfolio = 'max_sharpe' and b.portfolio = 'min_vol'""",
        WEIGHTS,
    )
    q["weights_equal"] = sql(
        f"""select 'equal_wt' as portfolio, asset, {rnd('1.0 / (select count(distinct asset) from obs)', 6)} as weight
        from obs group by asset"""
    )
    q["clean_weights"] = f"""
        select printf('S%08d', l_suppkey) as asset, case when share < 0.0001 then 0.0 else {even('share', 5)} end as weight
        from (select l_suppkey, sum(l_extendedprice) / (select sum(l_extendedprice) from lineitem) as share
              from lineitem group by l_suppkey)"""
    q["portfolio_value"] = sql(f"select portfolio, {day()} as date, {rnd('value')} as value from v", WEIGHTS)
    q["portfolio_performance"] = sql(
        f"""select portfolio, {rnd('ret')} as expected_return, {rnd('vol')} as volatility,
            {rnd('(ret - 0.02) / vol')} as sharpe
        from (select portfolio, sum(weight * mu) as ret from w join mu using (asset) group by portfolio)
        join (select a.portfolio, sqrt(sum(a.weight * b.weight * cov)) as vol
              from w a join w b on a.portfolio = b.portfolio join lw on lw.i = a.asset and lw.j = b.asset
              group by a.portfolio) using (portfolio)""",
        LW, MU, WEIGHTS,
    )
    scores = f"""i, j, {rnd('w')} as w, {rnd('ret')} as expected_return, {rnd('vol')} as volatility,
        {rnd('sharpe')} as sharpe"""
    q["frontier_points"] = sql(
        f"""select universe, bucket, {scores} from (
            select *, row_number() over (partition by universe, bucket order by ret desc, i, j, w) as place from (
              select s.*, cast(least(floor((vol - lo) / (hi - lo) * 20), 19) as integer) as bucket
              from scored s join (select universe, min(vol) as lo, max(vol) as hi from scored group by universe) b
              using (universe))) where place = 1""",
        *UNIVERSE_CANDIDATES,
    )
    q["best_candidate"] = sql(f"select universe, portfolio, {scores} from chosen", *UNIVERSE_CANDIDATES)

    q["portfolio_summary"] = sql(
        f"""select * from (select portfolio, freq, {STATS} from pr group by portfolio, freq)
        join (select portfolio, {even('(max_by(value, date) / min_by(value, date) - 1) * 100')} as overall_return
              from v group by portfolio) using (portfolio)""",
        WEIGHTS, PORTFOLIO_RETURNS,
    )
    bins = "case freq when 'daily' then 40 when 'monthly' then 20 when 'quarterly' then 10 else 7 end"
    shown = f"bin, {rnd('lower')} as lower, {rnd('upper')} as upper, frequency"
    q["return_histogram"] = sql(
        f"select portfolio, freq, {shown} from h", WEIGHTS, PORTFOLIO_RETURNS, histogram("pr", "portfolio, freq", bins)
    )
    per_portfolio = ", ".join(
        "{} as " + p for p in PORTFOLIOS
    )
    ratio = [rnd(f"max(case when portfolio = '{p}' then sharpe end)") for p in PORTFOLIOS]
    q["sharpe_annual"] = sql(
        f"select {day('label')} as date, {per_portfolio.format(*ratio)} from s group by label",
        WEIGHTS,
        """vr as (select portfolio, date, value / lag(value) over (partition by portfolio order by date) - 1 as r from v),
        s as (
          select g.portfolio, g.label, sqrt(252) * avg(r) / nullif(stddev_samp(r), 0) as sharpe
          from (select portfolio, make_date(y, 12, 31) as label from
                (select portfolio, unnest(range(min(year(date)), max(year(date)) + 1)) as y from v group by portfolio)) g
          left join vr on vr.portfolio = g.portfolio and year(vr.date) = year(g.label) group by g.portfolio, g.label)""",
    )
    cum = [f"max(case when portfolio = '{p}' then cum end)" for p in PORTFOLIOS]
    q["return_comparison"] = sql(
        f"""select {day()} as date, {per_portfolio.format(*cum)} from c where date >= date '1997-01-01'
        group by date having count(*) = {len(PORTFOLIOS)}""",
        WEIGHTS,
        f"""vr as (select portfolio, date, value / lag(value) over (partition by portfolio order by date) - 1 as r from v),
        c as (select portfolio, date, {even('(product(1 + r) over (partition by portfolio order by date) - 1) * 100')} as cum
              from vr)""",
    )
    q["asset_summary"] = sql(
        f"select asset, {STATS}, {rnd('min(r) * 100')} as worst, {rnd('max(r) * 100')} as best from r group by asset"
    )
    q["asset_histogram"] = sql(f"select asset, {shown} from h", histogram("r", "asset", "40"))
    q["linear_trend"] = f"""
        select asset, {rnd('regr_slope(price, n)')} as slope, {rnd('regr_intercept(price, n)')} as intercept,
               {rnd('regr_r2(price, n)')} as r2, count(price) as n_prices
        from (select printf('S%08d', l_suppkey) as asset, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as n,
                     {PRICE} as price from lineitem group by 1, 2) group by asset"""
    q["iqr_by_frequency"] = sql(
        f"""select asset, freq, {rnd('(quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) * 100')} as iqr,
        count(r) as n_returns from pr group by asset, freq""",
        period_returns("p", "asset", "price", ["monthly", "quarterly"]),
    )

    q["rebalance_dates"] = sql(f"select {day('rebalance_date')} as rebalance_date from reb", ASOF)
    q["mu_by_rebalance"] = sql(
        f"select {day('rebalance_date')} as rebalance_date, asset, {rnd('mu')} as mu from asof_mu", ASOF
    )
    q["cov_by_rebalance"] = sql(
        f"""select {day('rebalance_date')} as rebalance_date, i, j, {rnd('cov')} as cov, {rnd('delta')} as delta
        from lw""",
        ASOF, ASOF_COV,
    )
    q["rebalance_turnover"] = sql(
        f"""select portfolio, {day('rebalance_date')} as rebalance_date, {rnd('sum(abs(neww - oldw))')} as turnover,
            count(*) filter (neww <> oldw) as n_changed
        from (
          select portfolio, due as rebalance_date, asset, sum(n) as neww, sum(o) as oldw from (
            select portfolio, rebalance_date as due, asset, weight as n, 0.0 as o from cw
            union all
            select cw.portfolio, nxt, asset, 0.0, weight from cw
            join rd on rd.portfolio = cw.portfolio and rd.rebalance_date = cw.rebalance_date where nxt is not null)
          group by all)
        group by portfolio, rebalance_date""",
        ASOF, ASOF_COV, ASOF_WEIGHTS,
    )
    q["rebalanced_return"] = sql(
        f"""select portfolio, {day()} as date, {rnd('r')} as r,
            {rnd('sum(ln(1 + r)) over (partition by portfolio order by date)')} as log_growth
        from (
          select cw.portfolio, r.date, sum(weight * r.r) as r from cw
          join rd on rd.portfolio = cw.portfolio and rd.rebalance_date = cw.rebalance_date
          join r on r.asset = cw.asset and r.date > cw.rebalance_date and (nxt is null or r.date <= nxt)
          group by all)""",
        ASOF, ASOF_COV, ASOF_WEIGHTS,
    )
    return q
