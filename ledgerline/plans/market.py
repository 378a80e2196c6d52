"""Bars, setups, sectors, macro, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import pct_change
from ..functions.series import Bars, wilder_atr, with_indicators
from ..operators import asof, groups, portfolio, setups
from ..session import read
from . import adapters as a
from .registry import query

B = "v_bars"
_W = Bars()


def _win(expr: str, n: int, of: str = "close") -> str:
    """SQL of a frame function over the last n bars, null until they are there."""
    frame = f"over (partition by ticker order by day rows between {n - 1} preceding and current row)"
    return f"case when count({of}) {frame} = {n} then {expr} {frame} end"


def _d(expr: str, name: str) -> str:
    return f"cast(cast({expr} as decimal(38,6)) as double) as {name}"


@query(a.with_views(f"select ticker, day, {_d(_win('avg(close)', 20), 'sma20')}, {_d(_win('avg(close)', 50), 'sma50')} from v_bars", B))
def sma(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.sma(F.col("close"), 20)).alias("sma20"), a.r6(_W.sma(F.col("close"), 50)).alias("sma50"))


@query(a.with_views(f", x as (select ticker, day, {_win('stddev_pop(close)', 20)} as sd, {_win('avg(close)', 20)} as mu from v_bars) select ticker, day, {_d('4 * sd / nullif(mu, 0)', 'bbw')} from x", B))
def bollinger_width(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.bollinger_width()).alias("bbw"))


@query(a.with_views(f", x as (select ticker, day, close, {_win('max(high)', 20)} as hi, {_win('min(low)', 20)} as lo from v_bars) select ticker, day, {_d('(hi - lo) / nullif(close, 0)', 'donchian')} from x", B))
def donchian_width(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.donchian_width()).alias("donchian"))


_TR = "greatest(high - low, abs(high - lag(close) over (partition by ticker order by day)), abs(low - lag(close) over (partition by ticker order by day)))"


@query(a.with_views(f"select ticker, day, {_d(_TR, 'tr')} from v_bars", B))
def true_range(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.true_range()).alias("tr"))


@query("with recursive " + f"v_bars as ({a.SQL[B]}), t as (select ticker, day, {_TR} as tr, row_number() over (partition by ticker order by day) as i from v_bars), s as (select ticker, avg(tr) as v from t where i <= 14 group by 1 having count(*) = 14), r as (select ticker, 14::bigint as i, v from s union all select r.ticker, t.i, (r.v * 13 + t.tr) / 14 from r join t on t.ticker = r.ticker and t.i = r.i + 1) select t.ticker, t.day, {_d('r.v', 'atr')} from t left join r on r.ticker = t.ticker and r.i = t.i")
def wilder(spark, sf):
    df = a.bars(spark, sf)
    return wilder_atr(df.withColumn("tr", _W.true_range()), _W).select("ticker", "day", a.r6(F.col("atr")).alias("atr"))


@query(a.with_views(f", x as (select ticker, day, close, row_number() over (partition by ticker order by day) as i from v_bars) select x.ticker, x.day, {_d('100.0 * count(*) filter (where y.close <= x.close) / count(*)', 'rank')} from x join x y on y.ticker = x.ticker and y.i between x.i - 251 and x.i group by x.ticker, x.day", B))
def percentile_rank(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.percentile_rank(F.col("close"))).alias("rank"))


@query(a.with_views(", x as (select *, high - low as r, lag(high) over w as ph, lag(low) over w as pl, min(high - low) over (partition by ticker order by day rows between 6 preceding and current row) as m, count(*) over (partition by ticker order by day rows between 6 preceding and current row) as c from v_bars window w as (partition by ticker order by day)) select ticker, day, c = 7 and r <= m as nr7, coalesce(high <= ph and low >= pl, false) as inside_day from x", B))
def nr7_inside(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", _W.nr7().alias("nr7"), _W.inside_day().alias("inside_day"))


@query(a.with_views(f", x as (select ticker, day, volume, avg(volume) over w as m, count(*) over w as c from v_bars window w as (partition by ticker order by day rows between 20 preceding and 1 preceding)) select ticker, day, {_d('case when c = 20 then volume / nullif(m, 0) end', 'rvol')} from x", B))
def rvol(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.rvol()).alias("rvol"))


@query(a.with_views("select ticker, day, max(high) over w as high52, min(low) over w as low52 from v_bars window w as (partition by ticker order by day rows between 251 preceding and current row)", B))
def week52(spark, sf):
    high, low = _W.week52()
    return a.bars(spark, sf).select("ticker", "day", high.alias("high52"), low.alias("low52"))


@query(a.with_views(f"select ticker, day, {_d(_win('avg(volume)', 20, 'volume'), 'adv')}, {_d(_win('avg(close * volume)', 20), 'addv')} from v_bars", B))
def average_volume(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(_W.average_volume(20)).alias("adv"), a.r6(_W.dollar_volume(20)).alias("addv"))


@query(a.with_views(f", x as (select *, row_number() over (partition by ticker order by day desc) as n from v_bars), l as (select ticker, close from x where n = 1), f as (select ticker, arg_max(close, n) as c from x where n <= 31 group by 1) select ticker, {_d('100.0 * (l.close - f.c) / f.c', 'ret')} from l join f using (ticker)", B))
def horizon_return(spark, sf):
    df = a.bars(spark, sf).withColumn("ret", _W.horizon_return(30))
    return df.groupBy("ticker").agg(F.max_by("ret", "day").alias("ret")).select("ticker", a.r6(F.col("ret")).alias("ret"))


_WIDE = setups.Thresholds(max_base_depth=0.9999, min_avg_dollar_volume=0.0)
_NEAR = ", b as (select *, row_number() over (partition by ticker order by day desc) as n from v_bars), d as (select *, max(high) over w as hi, min(low) over w as lo from b where n <= 60 window w as (partition by ticker order by day desc)), f as (select ticker, max(n) as len from d where hi > 0 and (hi - lo) / hi <= 0.9999 and n >= 7 group by 1)"


@query(a.with_views(_NEAR + f" select d.ticker, cast(d.n as integer) as base_length, d.day as base_start, d.hi as base_high, d.lo as base_low, {_d('(d.hi - d.lo) / d.hi', 'base_depth')} from d join f on d.ticker = f.ticker and d.n = f.len", B))
def find_base(spark, sf):
    return setups.bases(a.bars(spark, sf), _WIDE).withColumn("base_depth", a.r6(F.col("base_depth")))


@query(a.with_views(_NEAR + f", i as (select d.*, f.len, case when d.n > f.len - f.len // 3 then 1 when d.n <= f.len // 3 then 3 else 2 end as part from d join f on d.ticker = f.ticker and d.n <= f.len), p as (select ticker, max(high) filter (where n > 1) as pivot from i group by 1) select i.ticker, any_value(p.pivot) as pivot, cast(count(*) filter (where n > 1 and high >= p.pivot * 0.98) as integer) as touches, " + ", ".join(_d(f"(max(high) filter (where part = {k}) - min(low) filter (where part = {k})) / avg(close) filter (where part = {k})", f"ratio{k}") for k in (1, 2, 3)) + f", {_d('avg(volume) filter (where part = 3) / avg(volume) filter (where part = 1)', 'dryup')} from i join p on p.ticker = i.ticker group by i.ticker", B))
def contraction(spark, sf):
    df = a.bars(spark, sf)
    m = setups.base_measures(df, setups.bases(df, _WIDE), _WIDE)
    return m.select("ticker", "pivot", "touches", *[a.r6(F.col(c)).alias(c) for c in ("ratio1", "ratio2", "ratio3", "dryup")])


#: All indicators, unrounded: ``p`` has a row a bar.
_INDICATORS = f"""with recursive v_bars as ({a.SQL[B]}),
t as (select *, {_TR} as tr, row_number() over (partition by ticker order by day) as i from v_bars),
s as (select ticker, avg(tr) as v from t where i <= 14 group by 1 having count(*) = 14),
r as (select ticker, 14::bigint as i, v from s union all select r.ticker, t.i, (r.v * 13 + t.tr) / 14 from r join t on t.ticker = r.ticker and t.i = r.i + 1),
u as (select t.*, r.v as atr from t left join r on r.ticker = t.ticker and r.i = t.i),
k as (select *, 100.0 * atr / nullif(close, 0) as atr_pct, 4 * {_win('stddev_pop(close)', 20)} / nullif({_win('avg(close)', 20)}, 0) as bbw,
  ({_win('max(high)', 20)} - {_win('min(low)', 20)}) / nullif(close, 0) as donchian, {_win('avg(close)', 20)} as sma20, {_win('avg(close)', 50)} as sma50, {_win('avg(close)', 200)} as sma200,
  coalesce(count(*) over w7 = 7 and high - low <= min(high - low) over w7, false) as nr7, coalesce(high <= lag(high) over w and low >= lag(low) over w, false) as inside_day,
  case when count(volume) over w20 = 20 then volume / nullif(avg(volume) over w20, 0) end as rvol, {_win('avg(close * volume)', 20)} as adv20, max(high) over w252 as week52_high, min(low) over w252 as week52_low
  from u window w as (partition by ticker order by day), w7 as (partition by ticker order by day rows between 6 preceding and current row), w20 as (partition by ticker order by day rows between 20 preceding and 1 preceding), w252 as (partition by ticker order by day rows between 251 preceding and current row)),
q as (select *, {", ".join(f"list({c}) filter (where {c} is not null) over w as l_{c}" for c in ("atr_pct", "bbw", "donchian"))} from k window w as (partition by ticker order by day rows between 251 preceding and current row)),
p as (select *, {", ".join(f"case when {c} is not null then 100.0 * len(list_filter(l_{c}, lambda y: y <= {c})) / len(l_{c}) end as {c}_percentile" for c in ("atr_pct", "bbw", "donchian"))} from q)"""
_INDICATED = ("tr", "atr", "atr_pct", "bbw", "donchian", "sma20", "sma50", "sma200", "rvol", "adv20", "atr_pct_percentile", "bbw_percentile", "donchian_percentile")


def _rounded(df):
    """Doubles to six decimals."""
    return df.select(*[a.r6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields])


@query(_INDICATORS + f" select ticker, day, open, high, low, close, volume, nr7, inside_day, week52_high, week52_low, {', '.join(_d(c, c) for c in _INDICATED)} from p")
def indicators(spark, sf):
    return _rounded(with_indicators(a.bars(spark, sf)))


def _scan_sql(t: setups.Thresholds) -> str:
    """``g`` has the setup of each ticker's latest bar, without memory of an earlier scan."""
    ratio = lambda k: f"(max(high) filter (where part = {k}) - min(low) filter (where part = {k})) / nullif(avg(close) filter (where part = {k}), 0)"
    clamp = lambda x: f"case when ({x}) is not null then greatest(0.0, least(1.0, {x})) end"
    parts = {
        "contraction": f"case when ratio1 > 0 then {clamp('(1.0 - ratio3 / ratio1) / 0.5')} end", "bbw": clamp("1.0 - bbw_percentile / 100.0"),
        "proximity": f"case when distance_pct <= 0 then 1.0 else {clamp(f'1.0 - distance_pct / 100.0 / {t.pivot_proximity}')} end", "expansion": "cast(prior_expansion as integer)", "touches": "least(touches, 4) / 4.0", "dryup": clamp("(1.0 - dryup) / 0.5"), "tightness": "n_signals / 4.0",
    }
    total = " + ".join(f"{w} * coalesce({parts[k]}, 0.0)" for k, w in setups.WEIGHTS.items())
    return _INDICATORS + f""",
b as (select *, row_number() over (partition by ticker order by day desc) as n, count(*) over (partition by ticker) as n_bars, max(nr7::int) over (partition by ticker order by day rows between 2 preceding and current row) as nr7_recent, max(inside_day::int) over (partition by ticker order by day rows between 1 preceding and current row) as inside_recent from p),
d as (select *, max(high) over w as hi, min(low) over w as lo from b where n <= {t.max_base_len} window w as (partition by ticker order by day desc)),
f as (select ticker, max(n) as len from d where hi > 0 and (hi - lo) / hi <= {t.max_base_depth} and n >= {t.min_base_len} group by 1),
e as (select d.ticker, d.n as base_length, d.day as base_start, (d.hi - d.lo) / d.hi as base_depth from d join f on d.ticker = f.ticker and d.n = f.len),
i as (select b.*, f.len, case when b.n > f.len - f.len // 3 then 1 when b.n <= f.len // 3 then 3 else 2 end as part from b join f on b.ticker = f.ticker and b.n <= f.len),
v as (select ticker, max(high) filter (where n > 1) as pv from i group by 1),
m as (select i.ticker, any_value(v.pv) as pv, cast(count(*) filter (where n > 1 and high >= v.pv * (1.0 - {t.pivot_tolerance})) as integer) as touches, {", ".join(f"{ratio(k)} as ratio{k}" for k in (1, 2, 3))}, avg(volume) filter (where part = 3) / nullif(avg(volume) filter (where part = 1), 0) as dryup from i join v on v.ticker = i.ticker group by 1),
h as (select b.ticker, max(n_bars - base_length) as start, avg(atr_pct) filter (where b.n - base_length <= 20) as pre, list(atr_pct) filter (where atr_pct is not null) as history, median(atr_pct) as mid from b join e on b.ticker = e.ticker where b.n - base_length between 1 and {t.lookback_percentile} group by 1),
x as (select ticker, coalesce(start >= 20 and len(history) >= 20 and mid > 0 and pre >= mid * {t.expansion_margin} and 100.0 * len(list_filter(history, lambda y: y <= pre)) / len(history) >= {t.expansion_percentile}, false) as prior_expansion from h),
j as (select b.*, e.base_length, e.base_start, e.base_depth, m.pv, m.touches, m.ratio1, m.ratio2, m.ratio3, m.dryup, x.prior_expansion, 100.0 * (m.pv - close) / nullif(close, 0) as distance_pct,
  nr7_recent + inside_recent + coalesce(bbw_percentile <= {t.bbw_percentile}, false)::int + coalesce(donchian_percentile <= {t.donchian_percentile}, false)::int as n_signals,
  coalesce(m.ratio1 > 0 and m.ratio2 > 0 and m.ratio2 <= m.ratio1 * {t.contraction_tolerance} and m.ratio3 <= m.ratio2 * {t.contraction_tolerance}, false) as contraction_monotone, b.day - e.base_start <= {t.technical_horizon_days} as within_horizon
  from b left join e on b.ticker = e.ticker left join m on m.ticker = b.ticker left join x on x.ticker = b.ticker where b.n = 1),
o as (select *, case when n_bars < {t.min_bars} or adv20 < {t.min_avg_dollar_volume} then 'none' when base_length is null then case when atr_pct_percentile >= {t.expansion_percentile} then 'expansion' else 'none' end when close > pv then 'triggered'
  when contraction_monotone and n_signals > 0 and (bbw_percentile is null or bbw_percentile <= {t.max_bbw_percentile}) and touches >= {t.min_pivot_touches} and distance_pct between 0.0 and {100.0 * t.pivot_proximity} then 'coiled' else 'basing' end as stage from j),
g as (select ticker, day as as_of, stage, case when n_bars < {t.min_bars} then 'insufficient_history' when adv20 < {t.min_avg_dollar_volume} then 'illiquid' when base_length is null and stage = 'none' then 'no_base' end as reason,
  case when stage in ('triggered', 'coiled', 'basing') then cast(round_even({total}, 0) as integer) else 0 end as score, close, pv as "pivot", touches, distance_pct, base_start, cast(base_length as integer) as base_length, 100.0 * base_depth as base_depth_pct, ratio1, ratio2, ratio3,
  contraction_monotone, prior_expansion, dryup, within_horizon, case when stage = 'triggered' then rvol >= {t.volume_confirm_rvol} end as volume_confirmed, atr_pct, atr_pct_percentile, bbw, bbw_percentile, donchian_percentile, nr7, inside_day, rvol, adv20, sma20, sma50, sma200,
  {", ".join(f"100.0 * (close - {s}) / nullif({s}, 0) as dist_{s}_pct" for s in ("sma20", "sma50", "sma200"))}, week52_high, week52_low, 100.0 * (close - week52_low) / nullif(week52_high - week52_low, 0) as week52_position_pct from o)"""


_PLAIN = ("ticker", "as_of", "stage", "reason", "score", "touches", "base_start", "base_length", "contraction_monotone", "prior_expansion", "within_horizon", "volume_confirmed", "nr7", "inside_day")
_DOUBLES = ("close", "pivot", "distance_pct", "base_depth_pct", "ratio1", "ratio2", "ratio3", "dryup", "atr_pct", "atr_pct_percentile", "bbw", "bbw_percentile", "donchian_percentile", "rvol", "adv20", "sma20", "sma50", "sma200", "dist_sma20_pct", "dist_sma50_pct", "dist_sma200_pct", "week52_high", "week52_low", "week52_position_pct")
_SCANNED = f" select {', '.join(_PLAIN)}, {', '.join(_d(f'"{c}"', f'"{c}"') for c in _DOUBLES)} from g"


@query(_scan_sql(_WIDE) + _SCANNED)
def setup_scan(spark, sf):
    return _rounded(setups.scan(a.bars(spark, sf), t=_WIDE))


_NARROW = setups.Thresholds(max_base_depth=0.985, min_bars=100, min_avg_dollar_volume=600_000.0)


@query(_scan_sql(_NARROW) + _SCANNED)
def setup_scan_narrow(spark, sf):
    """Where bases are shorter, thirds uneven and the liquidity floor bites."""
    return _rounded(setups.scan(a.bars(spark, sf), t=_NARROW))


@query(_scan_sql(setups.Thresholds()) + _SCANNED)
def setup_scan_default(spark, sf):
    return _rounded(setups.scan(a.bars(spark, sf)))


@query(_scan_sql(_WIDE) + r""", z as (select *, cast(round_even(bbw_percentile, 0) as integer) as b from g)
select ticker, stage, score, ticker || ' — ' || coalesce(case reason when 'insufficient_history' then 'not enough history yet' when 'illiquid' then 'below the liquidity floor (20d avg $' || printf('%.1f', coalesce(adv20, 0) / 1e6) || 'M)' end,
  case stage when 'expansion' then 'expanding, no base' when 'basing' then printf('basing %dd, %.1f%% deep', base_length, base_depth_pct) when 'none' then 'no setup' else stage || ', score ' || score end
  || coalesce(', BBW ' || b || case when b % 100 between 10 and 20 then 'th' when b % 10 = 1 then 'st' when b % 10 = 2 then 'nd' when b % 10 = 3 then 'rd' else 'th' end || ' pct', '')
  || coalesce(printf(', %.1f%% ', abs(dist_sma20_pct)) || case when dist_sma20_pct >= 0 then 'above' else 'below' end || ' SMA20', '') || coalesce(printf(', %.0f%% of 52w range', week52_position_pct), '')) as line from z""")
def setup_lines(spark, sf):
    return setups.scan(a.bars(spark, sf), t=_WIDE).select("ticker", "stage", "score", setups.status_line().alias("line"))


def _sectors(spark, sf):
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    members = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sector"), F.col("n_name").alias("ticker"))
    per = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    returns = per.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("ticker"), (F.col("hi") / 1000 + F.col("lo") / 1000).alias("ret"))
    return members.unionByName(spark.sql("select 'ASIA' as sector, 'ATLANTIS' as ticker union all select 'NOWHERE', 'LEMURIA'")), returns


_SECTORS = "m as (select r_name as sector, n_name as ticker from nation join region on n_regionkey = r_regionkey union all select 'ASIA', 'ATLANTIS' union all select 'NOWHERE', 'LEMURIA'), t as (select n_name as ticker, max(c_acctbal) / 1000 + min(c_acctbal) / 1000 as ret from customer join nation on c_nationkey = n_nationkey group by 1), j as (select m.sector, m.ticker, t.ret from m left join t using (ticker)), v as (select sector, count(ret) as n, median(ret) as mid, stddev_pop(ret) as spread, count(*) filter (where ret > 0) as up from j group by 1)"
_COHESION = "case when n < 2 or spread is null then 'unknown' when spread <= 4 then 'bloc' when spread >= 10 then 'scattered' else 'mixed' end"


@query(f"with {_SECTORS} select sector, n, {_d('case when n >= 2 then mid end', 'median_return')}, {_d('case when n >= 2 then spread end', 'dispersion')}, {_COHESION} as cohesion, case when n >= 2 then up end as breadth_up, case when n >= 2 then coalesce((select string_agg(ticker, ',' order by ret, ticker) from j where j.sector = v.sector and ret > mid + 3), '') end as leaders, case when n >= 2 then coalesce((select string_agg(ticker, ',' order by ret, ticker) from j where j.sector = v.sector and ret < mid - 3), '') end as laggards, coalesce((select string_agg(ticker, ',' order by ticker) from j where j.sector = v.sector and ret is null), '') as missing from v")
def sector_view(spark, sf):
    v = groups.sector_view(*_sectors(spark, sf))
    return v.withColumns({"median_return": a.r6(F.col("median_return")), "dispersion": a.r6(F.col("dispersion"))})


@query(f"with {_SECTORS} select sector, ticker, {_d('ret', 'own_return')}, {_d('mid', 'median_return')}, {_d('ret - mid', 'gap')}, case when ret - mid > 3 then 'leading' when ret - mid < -3 then 'lagging' else 'in_line' end as position, {_COHESION} as cohesion, {_COHESION} = 'bloc' and ret - mid between -3 and 3 as carried from j join v using (sector) where ret is not null and n >= 2")
def sector_standing(spark, sf):
    members, returns = _sectors(spark, sf)
    s = groups.standing(groups.sector_view(members, returns), members, returns)
    return s.withColumns({c: a.r6(F.col(c)) for c in ("own_return", "median_return", "gap")})


_NAMES = {"leaders": "ret > mid + 3", "laggards": "ret < mid - 3", "missing": "ret is null"}


@query(f"with {_SECTORS}, y as (select *, {_COHESION} as c, " + ", ".join(f"(select string_agg(ticker, ', ' order by ret, ticker) from j where j.sector = v.sector and {w}) as {k}" for k, w in _NAMES.items()) + """ from v)
select sector, case when n < 2 then printf('%s: not enough history (%d members priced).', sector, n) else printf('%s: median %s%.1f%% over 30d, %d/%d up, ', sector, case when mid < 0 then '' else '+' end, mid, up, n)
  || case c when 'bloc' then 'moving together' when 'unknown' then 'unclear' else c end || coalesce('; leading ' || leaders, '') || coalesce('; lagging ' || laggards, '') || coalesce('; no data for ' || missing, '') || '.' end as line from y""")
def sector_lines(spark, sf):
    return groups.sector_view(*_sectors(spark, sf)).select("sector", groups.sector_line().alias("line"))


M = "v_macro"


@query(a.with_views(", n as (select series, max(as_of) as as_of, arg_max(value, as_of) as value from v_macro where series in ('view', 'click') group by 1) select a.as_of, a.value as low_value, b.value as high_value, b.value - a.value as spread, b.value < a.value as inverted from n a join n b on a.as_of = b.as_of where a.series = 'view' and b.series = 'click'", M))
def yield_curve(spark, sf):
    return asof.same_day_spread(a.macro(spark, sf), "view", "click")


@query(a.with_views(", s as (select series, max(as_of) as as_of, arg_max(value, as_of) as value, arg_max(value, as_of) filter (where notified_at is not null) as reported from v_macro group by 1) select series, as_of, value, reported, cast(5 as double) as move from s where reported is not null and abs(value - reported) + 1e-12 >= 5", M))
def macro_changed(spark, sf):
    m = a.macro(spark, sf)
    return asof.changed_since_reported(m, m.select("series").distinct().withColumn("move", F.lit(5.0)))


@query(a.with_views("select series, max(as_of) as as_of, arg_max(value, as_of) as value from v_macro group by 1", M))
def macro_snapshot(spark, sf):
    return asof.as_of(a.macro(spark, sf), ["series"], "as_of", "value", "2030-01-01")


T = "v_trades"


@query(a.with_views("select ticker, cast(sum(cast(case when side = 'buy' then quantity else -quantity end as decimal(38,6))) as double) as quantity from v_trades group by 1 having abs(sum(cast(case when side = 'buy' then quantity else -quantity end as decimal(38,6)))) > 1e-9", T))
def open_positions(spark, sf):
    return portfolio.open_tickers(a.trades(spark, sf))


#: The k-th unit bought meets the k-th unit sold; what one side has over the other is held.
_MATCHED = """, r as (select *, price + case when side = 'buy' then fee / quantity else -fee / quantity end as each, sum(quantity) over (partition by ticker, side order by trade_date, id) as hi from v_trades),
t as (select ticker, coalesce(sum(quantity) filter (where side = 'buy'), 0) as bought, coalesce(sum(quantity) filter (where side = 'sell'), 0) as sold from v_trades group by 1),
h as (select r.ticker, sum(case when side = 'buy' then greatest(hi - greatest(hi - quantity, sold), 0) else -greatest(hi - greatest(hi - quantity, bought), 0) end * each) as basis from r join t using (ticker) group by 1),
m as (select s.ticker, sum((least(s.hi, b.hi) - greatest(s.hi - s.quantity, b.hi - b.quantity)) * (s.each - b.each)) as pnl from r s join r b on s.ticker = b.ticker and s.side = 'sell' and b.side = 'buy' and s.hi - s.quantity < b.hi and b.hi - b.quantity < s.hi group by 1)
select t.ticker, bought - sold as quantity, cast(cast(case when bought <> sold then basis / (bought - sold) else 0 end + 1.3e-6 as decimal(38,2)) as double) as avg_cost, cast(cast(basis + 1.3e-6 as decimal(38,2)) as double) as cost_basis, cast(cast(coalesce(pnl, 0) + 1.3e-6 as decimal(38,2)) as double) as realized from t join h using (ticker) left join m using (ticker)"""


def _cents(held):
    """Money in cents; what lies between two of them, up to the order of additions, goes up."""
    return held.withColumns({c: (F.col(c) + 1.3e-6).cast("decimal(38,2)").cast("double") for c in ("avg_cost", "cost_basis", "realized")})


@query(a.with_views(_MATCHED, T))
def fifo_pnl(spark, sf):
    held = portfolio.fifo(a.trades(spark, sf))
    return _cents(held)


@query(a.with_views(_MATCHED, T).replace("l_returnflag = 'R'", "l_linenumber % 2 = 0"))
def fifo_shorts(spark, sf):
    """As many sells as buys, in any order: shorts and flips."""
    flipped = a.trades(spark, sf, F.col("l_linenumber") % 2 == 0)
    return _cents(portfolio.fifo(flipped))


#: Each ticker's first half buys and of more quantity than all sells together: the long-only form holds.
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_LONG = f"l as (select cast(l_suppkey as varchar) as ticker, cast(l_quantity as double) as q, l_extendedprice / l_quantity as p, row_number() over (partition by l_suppkey order by {_ORDER}) as i, count(*) over (partition by l_suppkey) as n from lineitem), t as (select ticker, i, case when 2 * i <= n + 1 then 'buy' else 'sell' end as side, case when 2 * i <= n + 1 then q + 100 else q end as quantity, p as price from l)"
_FIFO = f"with {_LONG}, r as (select *, sum(quantity) over (partition by ticker, side order by i) as hi from t), m as (select s.ticker, (least(s.hi, b.hi) - greatest(s.hi - s.quantity, b.hi - b.quantity)) * (s.price - b.price) as pnl from r s join r b on s.ticker = b.ticker and s.side = 'sell' and b.side = 'buy' and s.hi - s.quantity < b.hi and b.hi - b.quantity < s.hi) select ticker, cast(cast(sum(pnl) as decimal(38,2)) as double) as realized from m group by 1"


@query(_FIFO)
def fifo_long_only(spark, sf):
    return portfolio.realized(_long_trades(spark, sf)).withColumn("realized", F.col("realized").cast("decimal(38,2)").cast("double"))


@query(_FIFO)
def fifo_folded(spark, sf):
    trades = _long_trades(spark, sf)
    sold = trades.where("side = 'sell'").select("ticker").distinct()
    return portfolio.fifo(trades).join(sold, "ticker", "left_semi").select("ticker", F.col("realized").cast("decimal(38,2)").cast("double").alias("realized"))


def _long_trades(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    t = read(spark, sf, "lineitem").withColumn("ticker", F.col("l_suppkey").cast("string"))
    t = t.withColumn("id", F.row_number().over(w).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    buy = 2 * F.col("id") <= F.col("n") + 1
    return t.select("ticker", "id", F.lit("2024-01-01").cast("date").alias("trade_date"), F.when(buy, "buy").otherwise("sell").alias("side"), (F.col("l_quantity") + F.when(buy, 100).otherwise(0)).cast("double").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(0.0).alias("fee"))


@query(a.with_views(f", h as (select o_orderpriority as ticker, cast(sum(cast(o_totalprice as decimal(38,2))) as double) as basis from orders group by 1), l as (select ticker, arg_max(close, day) as last_close from v_bars group by 1) select ticker, 2.0::double as quantity, basis as cost_basis, last_close, 2 * last_close as market_value, {_d('100.0 * (2 * last_close - basis) / abs(basis)', 'unrealized_pct')} from h left join l using (ticker)", B))
def last_close_join(spark, sf):
    held = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("ticker")).agg(F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double").alias("cost_basis")).withColumn("quantity", F.lit(2.0))
    last = a.bars(spark, sf).groupBy("ticker").agg(F.max_by("close", "day").alias("last_close"))
    out = portfolio.priced(held, last)
    return out.select("ticker", "quantity", "cost_basis", "last_close", "market_value", a.r6(F.col("unrealized_pct")).alias("unrealized_pct"))


@query(a.with_views(f", x as (select ticker, day, close, lag(close) over (partition by ticker order by day) as p from v_bars) select ticker, day, {_d('100.0 * (close - p) / nullif(p, 0)', 'pct')} from x", B))
def pct_changes(spark, sf):
    return a.bars(spark, sf).select("ticker", "day", a.r6(pct_change(F.col("close"), F.lag("close").over(_W.w))).alias("pct"))
