"""DuckDB SQL for the registered queries, written apart from the Spark code to check it."""

from __future__ import annotations

from .operators.backtest import CATALOG
from .operators.smoothing import FACTORS, LEVELS, SEASONALS, SUPPORTED, TOP, TRENDS
from .operators.validate import PENALTY

ORDERS = """o as (select 'all' as series_id, cast(o_orderdate as date) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000 as y from orders group by 2)"""
PRIORITY = """o as (select o_orderpriority as series_id, cast(o_orderdate as date) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000 as y from orders group by 1, 2)"""
LINES = """o as (select l_returnflag as series_id, cast(l_shipdate as date) as ts, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / 1000 as y from lineitem group by 1, 2)"""
PLACED = """s as (select *, row_number() over (partition by series_id order by ts) - 1 as t, count(*) over (partition by series_id) as n from o)"""
MESSY = """m as (select event_type as series_id, event_id as seq, case when event_id % 17 <> 0 then cast(ts as date) end as ts,
  case when event_id % 11 = 0 or event_id % 13 = 0 then null else cast(cast(round(value, 2) as decimal(18,2)) as double) end as y,
  event_id % 11 <> 0 and event_id % 13 = 0 as raw_null from events)"""
KEPT = """k as (select series_id, ts, arg_max(struct_pack(y := y, raw_null := raw_null), seq) as x from m where ts is not null group by 1, 2), c as (select series_id, ts, x.y as y from k where x.y is not null)"""


def frequency(seconds: str) -> str:
    days = f"({seconds}) / 86400.0"
    near = lambda step: f"abs({days} - {step}) / {step} < 0.15"
    return f"case when {near(1)} then 'D' when {near(7)} then 'W' when {near(30)} or {near(30.5)} then 'MS' when {near(90)} then 'QS' when {near(365)} then 'YS' else 'IR' end"


def frequencies(source: str) -> str:
    """A relation series_id, median_seconds, frequency over a relation series_id, ts."""
    return f"""(select series_id, median_seconds, {frequency("median_seconds")} as frequency from (select series_id, quantile_cont(gap, 0.5) filter (gap > 0) as median_seconds
      from (select series_id, cast(date_diff('day', lag(ts) over (partition by series_id order by ts), ts) * 86400 as double) as gap from {source}) group by 1))"""


def rounded(*columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


# Backtest plan: sizes of four folds of daily data, one after another
FOLDS = """f0 as (select series_id, max(n) as n, greatest(30, cast(floor(max(n) * 0.6) as int)) as first from s group by 1),
f1 as (select *, n - first as l1 from f0 where n - first >= 10),
f2 as (select *, least(greatest(7, least(greatest(14, l1 // 4), l1)), l1) as z1 from f1),
f3 as (select *, l1 - z1 as l2 from f2), f4 as (select *, least(greatest(7, least(greatest(14, l2 // 3), l2)), l2) as z2 from f3),
f5 as (select *, l2 - z2 as l3 from f4), f6 as (select *, least(greatest(7, least(greatest(14, l3 // 2), l3)), l3) as z3 from f5),
f7 as (select *, l3 - z3 as l4 from f6), f8 as (select *, least(greatest(7, least(greatest(14, l4), l4)), l4) as z4 from f7),
folds as (select series_id, 'D' as frequency, fold, cast(train_end as int) as train_end, cast(train_end + size as int) as val_end, cast(size as int) as size from (
  select series_id, 1 as fold, first as train_end, z1 as size from f8 union all select series_id, 2, first + z1, z2 from f8
  union all select series_id, 3, first + z1 + z2, z3 from f8 union all select series_id, 4, first + z1 + z2 + z3, z4 from f8) where size > 0)"""
STEPS = """steps as (select f.*, h from folds f, lateral (select unnest(range(1, f.size + 1)) as h) u)"""
NAIVE = """d as (select *, y - lag(y) over (partition by series_id order by t) as d1 from s),
g as (select *, coalesce(stddev_pop(d1) over (partition by series_id order by t), 0) as sigma from d),
naive as (select p.series_id, 'naive' as model, p.fold, p.h, p.train_end, g.y as yhat, g.y - 1.96 * g.sigma * sqrt(p.h) as lower, g.y + 1.96 * g.sigma * sqrt(p.h) as upper from steps p join g on g.series_id = p.series_id and g.t = p.train_end - 1)"""
SEASONAL = """e as (select a.series_id, a.t, coalesce(stddev_pop(a.y - b.y) over (partition by a.series_id order by a.t), 0) as sigma from s a left join s b on a.series_id = b.series_id and b.t = a.t - 7),
snaive as (select p.series_id, 'seasonal_naive' as model, p.fold, p.h, p.train_end, b.y as yhat, b.y - 1.96 * e.sigma * sqrt(p.h) as lower, b.y + 1.96 * e.sigma * sqrt(p.h) as upper
  from steps p join s b on b.series_id = p.series_id and b.t = case when p.train_end >= 7 then p.train_end - 7 + (p.h - 1) % 7 else p.train_end - 1 end
  join e on e.series_id = p.series_id and e.t = p.train_end - 1)"""
SCORES = """made as (select * from naive union all select * from snaive),
pairs as (select m.*, a.y from made m join s a on a.series_id = m.series_id and a.t = m.train_end + m.h - 1),
scores as (select series_id, model, fold, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) * (y - yhat))) as rmse,
  case when count(*) filter (y = 0) = 0 then avg(abs((y - yhat) / y)) * 100 end as mape,
  avg(case when abs(y) + abs(yhat) > 0 then abs(y - yhat) / ((abs(y) + abs(yhat)) / 2) end) * 100 as smape,
  case when sum(abs(y)) > 0 then sum(abs(y - yhat)) / sum(abs(y)) * 100 else 0 end as wape, count(*) as n from pairs group by 1, 2, 3)"""
BOARD = """b0 as (select series_id, model, round(sum(mae * n) / sum(n), 4) as mae, round(sum(rmse * n) / sum(n), 4) as rmse, round(avg(mape), 4) as mape, round(sum(smape * n) / sum(n), 4) as smape, round(sum(wape * n) / sum(n), 4) as wape, count(*) as n_folds_valid from scores group by 1, 2),
b1 as (select *, row_number() over (partition by series_id order by smape, case model when 'naive' then 1 else 2 end) as rank from b0),
board as (select b1.*, x.n_folds_total, rank = 1 as is_best from b1 join (select series_id, count(*) as n_folds_total from folds group by 1) x using (series_id))"""
BACKTEST = f"with {PRIORITY}, {PLACED}, {FOLDS}, {STEPS}, {NAIVE}, {SEASONAL}, {SCORES}, {BOARD}"
# The last season carried 14 steps beyond the end
FINAL = f"""with {PRIORITY}, {PLACED},
e as (select a.series_id, a.t, coalesce(stddev_pop(a.y - b.y) over (partition by a.series_id order by a.t), 0) as sigma from s a left join s b on a.series_id = b.series_id and b.t = a.t - 7),
ends as (select series_id, max(n) as n, arg_max(y, ts) as last_y, max(ts) as last_ts from s group by 1),
final as (select x.series_id, h, b.y as yhat, b.y - 1.96 * e.sigma * sqrt(h) as lower, b.y + 1.96 * e.sigma * sqrt(h) as upper from ends x, lateral (select unnest(range(1, 15)) as h) u
  join s b on b.series_id = x.series_id and b.t = x.n - 7 + (h - 1) % 7 join e on e.series_id = x.series_id and e.t = x.n - 1)"""


def decomposed(period: int, tag: str = "") -> str:
    """CTEs up to dec: series_id, ts, t, y, trend, seasonal, resid."""
    h, p = period // 2, period
    w = "over (partition by series_id order by t"
    total = f"sum(y) {w} rows between {h} preceding and {h} following)"
    if period % 2 == 0:
        total = f"({total} - 0.5 * (lag(y, {h}) {w}) + lead(y, {h}) {w})))"
    line = lambda f, cond: f"{f}(ma, t) filter ({cond}) over (partition by series_id)"
    near, far = f"t < {h + p}", f"t >= n - {h} - 1 - {p} and t < n - {h} - 1"
    return f"""a{tag} as (select *, case when t >= {h} and t < n - {h} then {total} / {p} end as ma from s where n >= {2 * p}),
ln{tag} as (select series_id, regr_slope(ma, t) filter ({near}) as s1, regr_intercept(ma, t) filter ({near}) as i1, regr_slope(ma, t) filter ({far}) as s2, regr_intercept(ma, t) filter ({far}) as i2 from a{tag} where ma is not null group by 1),
tr{tag} as (select a.*, coalesce(ma, case when t < {h} then s1 * t + i1 else s2 * t + i2 end) as trend from a{tag} a join ln{tag} using (series_id)),
sl{tag} as (select series_id, t % {p} as slot, avg(y - trend) as raw from tr{tag} group by 1, 2),
se{tag} as (select series_id, slot, raw - avg(raw) over (partition by series_id) as seasonal from sl{tag}),
dec{tag} as (select x.series_id, ts, t, y, trend, seasonal, y - trend - seasonal as resid, n from tr{tag} x join se{tag} q on q.series_id = x.series_id and q.slot = x.t % {p})"""


def strengths(periods: list[tuple[str, int]], least: str = "2") -> str:
    """CTEs with a last one, st: series_id, name, period, strength, place."""
    parts = ", ".join(decomposed(p, f"_{p}") for _, p in periods)
    rows = " union all ".join(f"select series_id, '{name}' as name, {p} as period, {k} as place, case when var_pop(y) > 0 then greatest(0, 1 - var_pop(resid) / var_pop(y)) else 0 end as strength from dec_{p} where n >= {least} * {p} group by 1" for k, (name, p) in enumerate(periods))
    return f"{parts}, st as ({rows})"


SEASONS = [("weekly", 7), ("monthly", 30), ("quarterly", 91), ("yearly", 365)]


def detected(base: str) -> str:
    return f"""with {base}, {PLACED}, {strengths(SEASONS, "3")},
ok as (select series_id, name, period, round(least(strength, 1), 3) as strength, place from st where round(least(strength, 1), 3) >= 0.1),
best as (select *, row_number() over (partition by series_id order by strength desc, place) as k from ok),
season as (select i.series_id, b.name is not null as detected, b.name as seasonality_type, b.period, coalesce(b.strength, 0) as strength from (select distinct series_id from s) i left join (select * from best where k = 1) b using (series_id))"""


#: Two-sided 5 per cent limit of Student's t by its expansion around the normal limit; exact to five places from 30 rows on.
T_LIMIT = "(1.959964 + 2.372271 / (n - 2.0::double) + 2.822488 / pow(n - 2.0::double, 2) + 2.555850 / pow(n - 2.0::double, 3))"


def trend(source: str = "s") -> str:
    return f"""tr1 as (select series_id, count(*) as n, regr_slope(y, t) as slope, regr_intercept(y, t) as intercept, regr_sxx(y, t) as sxx, regr_syy(y, t) as syy, regr_sxy(y, t) as sxy, avg(y) as mean from {source} group by 1),
tr2 as (select *, slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) as t_stat from tr1),
trend as (select *, case when abs(t_stat) <= {T_LIMIT} then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as direction from tr2)"""


VOLATILITY = """vw as (select *, greatest(7, least(28, n // 5)) as w from s),
vs as (select a.series_id, a.t, max(a.w) as w, count(*) as k, stddev_samp(b.y) as sd from vw a join s b on a.series_id = b.series_id and b.t between a.t - a.w + 1 and a.t group by 1, 2),
ve as (select series_id, arg_min(sd, t) as early, arg_max(sd, t) as recent from vs where k >= w // 2 and sd is not null group by 1),
vol as (select x.series_id, overall, recent, early, recent / early as ratio, case when n < 15 then 'unknown' when recent / early > 1.25 then 'increasing' when recent / early < 0.8 then 'decreasing' else 'stable' end as level
  from (select series_id, count(*) as n, stddev_samp(y) as overall from s group by 1) x join ve using (series_id))"""
QUARTILES = """q as (select series_id, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from s group by 1)"""
DRIVERS = """drv as (select t.series_id, 'trend=' || case t.direction when 'increasing' then 'positive' when 'decreasing' then 'negative' else 'neutral' end
  || case when z.detected then ',seasonality=positive' else '' end
  || ',volatility=' || case v.level when 'increasing' then 'negative' else 'neutral' end as drivers,
  1 + cast(v.level = 'increasing' as int) as n_caveats from trend t join season z using (series_id) join vol v using (series_id))"""
_ROLL = lambda w: f"over (partition by series_id order by ts rows between {w - 1} preceding and current row)"


def _rolled(agg: str, w: int, least: int, name: str, digits: int = 7) -> str:
    value = f"case when count(y) {_ROLL(w)} >= {least} then {agg}(y) {_ROLL(w)} end"
    return f"{value} as {name}" if agg in ("min", "max") else f"round({value}, {digits}) as {name}"


_CALENDAR = """year(ts) as year, month(ts) as month, quarter(ts) as quarter, week(ts) as week, isodow(ts) - 1 as dayofweek, day(ts) as dayofmonth, isoyear(ts) as iso_year, isodow(ts) as iso_weekday,
round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 as sin_month, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 as cos_month, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 as sin_week, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 as cos_week,
round(sin(2 * pi() * day(ts) / 31), 6) + 0.0 as sin_dayofmonth, round(cos(2 * pi() * day(ts) / 31), 6) + 0.0 as cos_dayofmonth, cast(isodow(ts) >= 6 as int) as is_weekend, cast(day(ts) = 1 as int) as is_month_start,
cast(day(ts) >= 28 as int) as is_month_end, day(last_day(ts)) as days_in_month, dayofyear(ts) as day_of_year, week(ts) as week_of_year"""
_OFF = lambda cond, name: f"case when {cond} then {PENALTY[name]} else 0 end"

ORACLE_SQL = {
    "series_build": f"with {PRIORITY} select series_id, ts, y from o",
    "series_by_region": """select r_name as series_id, cast(o_orderdate as date) as ts, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000 as y from orders
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "coerce_clean": f"with {MESSY}, {KEPT} select series_id, ts, y from c",
    "cleaning_log": f"""with {MESSY}, g as (select series_id, ts, count(*) as n, arg_max(coalesce(y, 'nan'::double), seq) as y from m group by 1, 2),
        z as (select series_id, cast(sum(n) as bigint) as rows_in, cast(coalesce(sum(n) filter (ts is null), 0) as bigint) as bad_dates, cast(coalesce(sum(n - 1) filter (ts is not null), 0) as bigint) as duplicates, count(*) filter (ts is not null and isnan(y)) as null_targets from g group by 1)
        select *, rows_in - bad_dates - duplicates - null_targets as rows_out, concat_ws('; ', case when bad_dates > 0 then 'dropped ' || bad_dates || ' rows with invalid dates' end, 'sorted by date', case when duplicates > 0 then 'removed ' || duplicates || ' duplicate dates, kept the last' end, case when null_targets > 0 then 'dropped ' || null_targets || ' rows with missing targets' end) as transformations from z""",
    "dedup_keep_last": "select event_type as series_id, date_trunc('hour', ts) as ts, round(arg_max(value, event_id), 4) as y from events group by 1, 2",
    "min_history": """with u as (select cast(user_id as varchar) as series_id, count(distinct cast(ts as date)) as n from events group by 1) select series_id, n, case when n < 8 then 'needs at least 8 rows, has ' || n end as reason from u""",
    "freq_detect": f"""with {PRIORITY}, x as (select series_id, ts from o union all select distinct 'month', cast(date_trunc('month', o_orderdate) as date) from orders union all select distinct 'quarter', cast(date_trunc('quarter', o_orderdate) as date) from orders
        union all select distinct 'year', cast(date_trunc('year', o_orderdate) as date) from orders union all select distinct 'week', cast(date_trunc('week', o_orderdate) as date) from orders) select * from {frequencies("x")}""",
    "quality_report": f"""with {MESSY}, {KEPT}, raw as (select series_id, count(*) as rows_in, count(*) filter (ts is null) as bad_dates, count(*) filter (ts is not null) as dated, count(*) filter (ts is not null and raw_null) as missing_targets, count(*) filter (ts is not null and not raw_null and y is null) as unparsed_targets from m group by 1),
        dates as (select series_id, count(*) as dates from k group by 1),
        prof as (select series_id, count(*) as n, min(ts) as start_ts, max(ts) as end_ts, count(*) filter (y < 0) as negatives, min(y) = max(y) as constant, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from c group by 1),
        outl as (select series_id, count(*) filter (q3 > q1 and (y < q1 - 3 * (q3 - q1) or y > q3 + 3 * (q3 - q1))) as outliers from c join prof using (series_id) group by 1),
        j as (select raw.series_id, rows_in, bad_dates, missing_targets, unparsed_targets, coalesce(n, 0) as n, start_ts, end_ts, coalesce(negatives, 0) as negatives, coalesce(constant, false) as constant, coalesce(outliers, 0) as outliers, coalesce(frequency, 'IR') as frequency, dated - coalesce(dates, 0) as duplicates,
          case when coalesce(n, 0) > 0 then date_diff('day', start_ts, end_ts) + 1 else 0 end as coverage_days from raw left join dates using (series_id) left join prof using (series_id) left join outl using (series_id) left join {frequencies("c")} f using (series_id)),
        g as (select *, case when frequency = 'D' and n < 0.95 * coverage_days then coverage_days - n else 0 end as missing_days, n = 0 or negatives > 0 as bad from j),
        v as (select *, 100 - {_OFF("missing_targets > 0", "missing")} - {_OFF("duplicates > 0", "duplicates")} - {_OFF("missing_days > 0", "gaps")} - {_OFF("frequency = 'IR'", "irregular")} - {_OFF("outliers > 0", "outliers")} - {_OFF("constant", "constant")} as raw_score from g)
        select * exclude (bad, raw_score), case when n = 0 then 0 when bad then least(greatest(raw_score, 0), 50) else greatest(raw_score, 0) end as score, not bad as is_valid,
        concat_ws('; ', case when bad_dates > 0 then 'warning:dates:' || bad_dates || ' rows have invalid dates' end, case when n = 0 then 'error:empty:no rows are left after cleaning' end, case when duplicates > 0 then 'warning:duplicates:' || duplicates || ' duplicate dates' end,
          case when missing_targets + unparsed_targets > 0 then 'warning:missing:' || (missing_targets + unparsed_targets) || ' missing target values' end, case when missing_days > 0 then 'warning:gaps:' || missing_days || ' days are missing' end, case when n > 0 and frequency = 'IR' then 'warning:frequency:the spacing of dates is irregular' end,
          case when negatives > 0 then 'error:negative:' || negatives || ' negative values' end, case when outliers > 0 then 'warning:outliers:' || outliers || ' values beyond 3 times the interquartile range' end, case when constant then 'warning:constant:the target is constant' end) as issues from v""",
    "calendar": f"with {ORDERS} select ts, {_CALENDAR} from o",
    "lags": f"with {PRIORITY} select series_id, ts, " + ", ".join(f"lag(y, {k}) over (partition by series_id order by ts) as lag_{k}" for k in (1, 2, 3, 7, 14, 28)) + " from o",
    "rolling": f"with {PRIORITY} select series_id, ts, " + ", ".join(_rolled(a, w, min(w, 14), f"rolling_{s}_{w}") for w in (7, 28) for s, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " from o",
    "momentum": f"with {PRIORITY}, r as (select *, case when count(y) {_ROLL(7)} >= 7 then avg(y) {_ROLL(7)} end as m from o), p as (select *, lag(m) over (partition by series_id order by ts) as b from r) select series_id, ts, round(case when b <> 0 then m / b - 1 when m <> 0 then sign(m) * 'inf'::double end, 6) as momentum from p",
    "feature_frame": f"""with {ORDERS}, r as (select *, case when count(y) {_ROLL(7)} >= 7 then avg(y) {_ROLL(7)} end as m7 from o), p as (select *, lag(m7) over (partition by series_id order by ts) as b from r)
        select series_id, ts, y, {_CALENDAR.replace(", 6)", ", 7)")}, """
    + ", ".join(f"lag(y, {k}) over (partition by series_id order by ts) as lag_{k}" for k in (1, 2, 3, 7, 14, 28, 30, 90, 365))
    + ", "
    + ", ".join(_rolled(a, w, min(w, 14), f"rolling_{s}_{w}") for w in (7, 14) for s, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + ", round(case when b <> 0 then m7 / b - 1 when m7 <> 0 then sign(m7) * 'inf'::double end, 7) + 0.0 as momentum from p",
    "differences": f"with {PRIORITY} select series_id, ts, y - lag(y, 1) over w as diff_1, y - lag(y, 7) over w as diff_7 from o window w as (partition by series_id order by ts)",
    "rolling_band": f"""with {ORDERS}, r as (select *, case when count(y) {_ROLL(28)} >= 28 then avg(y) {_ROLL(28)} end as roll_mean, case when count(y) {_ROLL(28)} >= 28 then stddev_samp(y) {_ROLL(28)} end as roll_std from o)
        select series_id, ts, {rounded("roll_mean", "roll_std", digits=3)}, round(roll_mean - 2 * roll_std, 3) as band_low, round(roll_mean + 2 * roll_std, 3) as band_high from r""",
    "preprocess_summary": f"""with {PRIORITY} select series_id, count(*) as n, min(ts) as start_ts, max(ts) as end_ts, round(avg(y), 3) as mean, round(stddev_samp(y), 3) as std, min(y) as min, max(y) as max, arg_max(y, ts) as recent from o group by 1""",
    "summary_stats": f"""with {PRIORITY}, p as (select *, lag(y) over (partition by series_id order by ts) as prev from o), g as (select series_id, min(y) as min, max(y) as max, round(avg(y), 3) as mean, round(median(y), 6) as median, round(stddev_samp(y), 3) as std, arg_min(y, ts) as first, arg_max(y, ts) as last_y, arg_max(prev, ts) as prev from p group by 1)
        select series_id, min, max, mean, median, std, first, last_y as recent, round((last_y - prev) / prev * 100, 4) as latest_change_pct from g""",
    "trend_ols": f"with {PRIORITY}, {PLACED}, {trend()} select series_id, n, round(slope, 4) as slope, round(intercept, 3) as intercept, round(t_stat, 3) as t_stat, round(slope / mean * 100, 3) as slope_pct, direction from trend",
    "volatility": f"with {PRIORITY}, {PLACED}, {VOLATILITY} select series_id, {rounded('overall', 'recent', 'early', 'ratio')}, level from vol",
    "histogram": f"""with {PRIORITY}, e as (select series_id, min(y) as lo, max(y) as hi from o group by 1) select series_id, cast(case when hi > lo then least(floor((y - lo) / ((hi - lo) / 40)), 39) else 0 end as int) as bin, count(*) as n from o join e using (series_id) group by 1, 2""",
    "decompose_p7": f"with {LINES}, {PLACED}, {decomposed(7)} select series_id, ts, " + ", ".join(f"round({c}, 3) + 0.0 as {c}" for c in ("y", "trend", "seasonal", "resid")) + " from dec",
    "decompose_p30": f"with {LINES}, {PLACED}, {decomposed(30)} select series_id, ts, " + ", ".join(f"round({c}, 3) + 0.0 as {c}" for c in ("y", "trend", "seasonal", "resid")) + " from dec",
    "seasonal_strength": f"with {LINES}, {PLACED}, {strengths(SEASONS)} select series_id, period, round(strength, 4) as strength from st",
    "seasonality_detect": f"""{detected(LINES)}, every as (select series_id, string_agg(name || '=' || period, ',' order by name) as periods from ok group by 1)
        select series_id, detected, seasonality_type, period, strength, coalesce(periods, '') as periods, case when not detected then 'no strong season was found' end as note from season left join every using (series_id)""",
    "periodicity": f"""with {LINES}, {PLACED}, {strengths([("weekly", 7), ("yearly", 365)], "3")}, r as (select *, row_number() over (partition by series_id order by strength desc, place) as k from st)
        select series_id, max(name) filter (k = 1) as "primary", round(max(strength) filter (name = 'weekly'), 4) as weekly, round(max(strength) filter (name = 'yearly'), 4) as yearly from r group by 1""",
    "decomposition_summary": f"with {LINES}, {PLACED}, {decomposed(7)} select series_id, round(arg_max(trend, t), 3) as trend_last, round(max(abs(seasonal)), 3) as seasonal_max, round(stddev_pop(resid), 3) as resid_std from dec group by 1",
    "iqr_anomalies": f"with {PRIORITY}, {PLACED}, {QUARTILES} select series_id, ts, y, round(q1 - (q3 - q1), 7) as low, round(q3 + (q3 - q1), 7) as high, q3 > q1 and (y < q1 - (q3 - q1) or y > q3 + (q3 - q1)) as is_anomaly from s join q using (series_id)",
    "rolling_mad": f"""with {PRIORITY}, r as (select *, case when count(y) {_ROLL(28)} >= 14 then median(y) {_ROLL(28)} end as med from o), a as (select *, abs(y - med) as off from r), b as (select *, case when count(off) {_ROLL(28)} >= 14 then median(off) {_ROLL(28)} end as mad from a)
        select series_id, ts, y, {rounded("med", "mad", digits=7)}, coalesce(off > 3 * 1.4826 * nullif(mad, 0), false) as is_anomaly from b""",
    "anomaly_digest": f"""with {PRIORITY}, {PLACED}, {QUARTILES}, f as (select series_id, ts, q3 > q1 and (y < q1 - (q3 - q1) or y > q3 + (q3 - q1)) as hit from s join q using (series_id)), r as (select *, row_number() over (partition by series_id order by hit desc, ts) as k from f)
        select series_id, count(*) filter (hit) as count, 'iqr_x1.0' as method, coalesce(string_agg(cast(ts as varchar), ',' order by ts) filter (hit and k <= 10), '') as dates from r group by 1""",
    "folds": f"with {PRIORITY}, {PLACED}, {FOLDS} select * from folds",
    "naive_forecasts": f"with {PRIORITY}, {PLACED}, {FOLDS}, {STEPS}, {NAIVE} select series_id, model, fold, h, {rounded('yhat', 'lower', 'upper', digits=3)} from naive",
    "seasonal_naive_forecasts": f"with {PRIORITY}, {PLACED}, {FOLDS}, {STEPS}, {SEASONAL} select series_id, model, fold, h, {rounded('yhat', 'lower', 'upper', digits=3)} from snaive",
    "metrics_by_fold": f"{BACKTEST} select series_id, model, fold, {rounded('mae', 'rmse', 'mape', 'smape', 'wape')}, n from scores",
    "leaderboard": f"{BACKTEST} select series_id, model, mae, rmse, mape, smape, wape, n_folds_valid, rank, n_folds_total, is_best from board",
    "mase": f"{BACKTEST}, z as (select *, abs(y - lag(y) over (partition by series_id, fold order by h)) as step from pairs where model = 'naive') select series_id, fold, round(case when avg(step) > 0 then avg(abs(y - yhat)) / avg(step) end, 4) as mase from z group by 1, 2",
    "holdout_mae": f"""with {PRIORITY}, {PLACED}, folds as (select series_id, 1 as fold, max(n) - least(7, greatest(1, cast(floor(max(n) * 0.1) as int))) as train_end, least(7, greatest(1, cast(floor(max(n) * 0.1) as int))) as size from s group by 1),
        {STEPS}, {NAIVE}, {SEASONAL}, {SCORES} select series_id, model, round(mae, 4) as holdout_mae, cast(null as varchar) as error from scores""",
    "horizon_dates": f"""with {ORDERS}, l as (select max(ts) as d from o), g as (select f as frequency, h, d from l, (select unnest(['D', 'W', 'MS', 'QS', 'YS', 'IR']) as f) a, (select unnest(range(1, 13)) as h) b)
        select frequency, h, cast(case frequency when 'W' then d + cast(7 * h as int) when 'MS' then date_trunc('month', d) + to_months(cast(h as int)) when 'QS' then date_trunc('quarter', d) + to_months(cast(3 * h as int)) when 'YS' then date_trunc('year', d) + to_months(cast(12 * h as int)) else d + cast(h as int) end as date) as ds from g""",
    "gaussian_band": f"""with {PRIORITY}, g as (select series_id, stddev_pop(y) as sigma, arg_max(y, ts) as yhat from o group by 1), z as (select * from (values (0.8::double, 1.2816), (0.9::double, 1.6449), (0.95::double, 1.96), (0.99::double, 2.5758)) v(coverage, z))
        select series_id, h, coverage, round(yhat, 3) as yhat, round(yhat - z * sigma * sqrt(h), 3) as lower, round(yhat + z * sigma * sqrt(h), 3) as upper from g, z, (select unnest(range(1, 15)) as h) u""",
    "band_annotation": f"{FINAL} select series_id, round(avg(upper - lower), 4) as mean_width, round(arg_min(upper - lower, h), 4) as start_width, round(arg_max(upper - lower, h), 4) as end_width, round(arg_max(upper - lower, h) / arg_min(upper - lower, h), 4) as widening from final group by 1",
    "expected_change": f"""{FINAL}, x as (select series_id, arg_max(yhat, h) as e from final group by 1) select series_id, round(e - last_y, 4) as absolute, round((e - last_y) / last_y * 100, 4) as percent, last_y as reference, case when e > last_y then 'increase' when e < last_y then 'decrease' else 'flat' end as direction from x join ends using (series_id)""",
    "horizon_means": f"{FINAL} select series_id, round(avg(yhat), 2) as mean_yhat, round(avg(lower), 2) as mean_lower, round(avg(upper), 2) as mean_upper from final group by 1",
    "residual_diagnostics": f"""with {PRIORITY}, r0 as (select series_id, ts, y - lag(y, 7) over (partition by series_id order by ts) as r from o), r1 as (select * from r0 where r is not null),
        r2 as (select *, r - avg(r) over (partition by series_id) as c, r - lag(r) over (partition by series_id order by ts) as d from r1),
        r3 as (select *, """
    + ", ".join(f"c * lag(c, {k}) over (partition by series_id order by ts) as p{k}" for k in range(1, 11))
    + """ from r2), g as (select series_id, count(*) as n, avg(r) as mean, stddev_samp(r) as std, avg(c * c * c) / pow(avg(c * c), 1.5) as skew, avg(c * c * c * c) / pow(avg(c * c), 2) - 3 as kurt, sum(d * d) / sum(r * r) as dw, """
    + " + ".join(f"pow(sum(p{k}) / sum(c * c), 2) / (count(*) - {k})" for k in range(1, 11))
    + """ as q from r3 group by 1), v as (select *, n * (n + 2) * q as lb, n / 6.0 * (skew * skew + kurt * kurt / 4) as jb from g),
        u as (select *, exp(-lb / 2) * (1 + lb / 2 + pow(lb / 2, 2) / 2 + pow(lb / 2, 3) / 6 + pow(lb / 2, 4) / 24) as lbp, exp(-jb / 2) as jbp from v)
        select series_id, n, round(mean, 4) as mean, round(std, 4) as std, round(skew, 4) as skew, round(kurt, 4) as excess_kurtosis, round(dw, 4) as durbin_watson, round(lb, 4) as ljung_box, round(lbp, 4) as ljung_box_p, round(jb, 4) as jarque_bera, round(jbp, 4) as jarque_bera_p, lbp > 0.05 as white_noise, jbp > 0.05 as normal from u""",
    "hw_fixed_params": f"""with recursive {ORDERS}, {PLACED}, r as (select series_id, t, y as level, 0.0::double as slope from s where t = 0 union all
        select s.series_id, s.t, 0.3 * s.y + 0.7 * (r.level + r.slope), 0.1 * (0.3 * s.y + 0.7 * (r.level + r.slope) - r.level) + 0.9 * r.slope from r join s on s.series_id = r.series_id and s.t = r.t + 1)
        select series_id, round(arg_max(level, t), 3) as level, round(arg_max(slope, t), 3) as slope from r group by 1""",
    "drivers": f"{detected(PRIORITY)}, {trend()}, {VOLATILITY}, {DRIVERS} select * from drv",
    "append_forecast": f"{FINAL} select series_id, ts, y, 'history' as kind from s union all select series_id, cast(last_ts + cast(h as int) as date), yhat, 'forecast' from final join ends using (series_id)",
    "model_catalog": "select * from (values " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(CATALOG)) + ") v(model_order, name, family, description)",
    "event_buckets": "select event_type as series_id, time_bucket(interval '6 hours', ts) as ts, round(sum(value), 3) as y, count(*) as n from events group by 1, 2",
}
_SUMMARY = f"""{detected(PRIORITY)}, {trend()}, {FOLDS}, {STEPS}, {NAIVE}, {SEASONAL}, {SCORES}, {BOARD}, ends as (select series_id, max(n) as n, arg_max(y, ts) as last_y, max(ts) as last_ts from s group by 1),
final as (select x.series_id, h, b.y as yhat, b.y - 1.96 * e.sigma * sqrt(h) as lower, b.y + 1.96 * e.sigma * sqrt(h) as upper from ends x, lateral (select unnest(range(1, 15)) as h) u
  join s b on b.series_id = x.series_id and b.t = x.n - 7 + (h - 1) % 7 join e on e.series_id = x.series_id and e.t = x.n - 1),
fin as (select series_id, arg_max(yhat, h) as e, arg_max(lower, h) as lower_end, arg_max(upper, h) as upper_end, round(avg(yhat), 2) as mean_yhat, round(avg(lower), 2) as mean_lower, round(avg(upper), 2) as mean_upper from final group by 1),
pr as (select series_id, count(*) as n, min(ts) as a, max(ts) as b, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3, min(y) = max(y) as constant from s group by 1),
ou as (select series_id, count(*) filter (q3 > q1 and (y < q1 - 3 * (q3 - q1) or y > q3 + 3 * (q3 - q1))) as outliers from s join pr using (series_id) group by 1),
qu as (select pr.series_id, ou.outliers, case when f.frequency = 'D' and pr.n < 0.95 * (date_diff('day', a, b) + 1) then (date_diff('day', a, b) + 1 - pr.n) || ' days are missing' when f.frequency = 'IR' then 'the spacing of dates is irregular' when outliers > 0 then outliers || ' values beyond 3 times the interquartile range' when constant then 'the target is constant' end as first_issue, 100 - case when f.frequency = 'D' and pr.n < 0.95 * (date_diff('day', a, b) + 1) then 10 else 0 end - case when f.frequency = 'IR' then 5 else 0 end - case when outliers > 0 then 5 else 0 end - case when constant then 20 else 0 end as quality_score from pr join ou using (series_id) join {frequencies("s")} f using (series_id)),
an as (select series_id, count(*) filter (q3 > q1 and (y < q1 - 3 * (q3 - q1) or y > q3 + 3 * (q3 - q1))) as anomaly_count from s join pr using (series_id) group by 1),
{VOLATILITY}, {DRIVERS},
su as (select board.series_id, board.model as best_model, board.smape, board.wape, round(fin.e - last_y, 4) as absolute, round((fin.e - last_y) / last_y * 100, 4) as percent, case when fin.e > last_y then 'increase' when fin.e < last_y then 'decrease' else 'flat' end as direction, mean_yhat, mean_lower, mean_upper,
  cast(last_ts + 1 as date) as start_date, round(fin.e, 3) as end_value, round(lower_end, 3) as lower_end, round(upper_end, 3) as upper_end, 'gaussian' as uncertainty_method, trend.direction as trend, detected, seasonality_type, period, strength, vol.level as volatility, anomaly_count, drv.drivers, quality_score, first_issue, 0 as missing_values, outliers as outlier_count, 14 as horizon
from board join fin using (series_id) join ends using (series_id) join trend using (series_id) join season using (series_id) join qu using (series_id) join an using (series_id) join vol using (series_id) join drv using (series_id) where is_best)"""
ORACLE_SQL["structured_summary"] = f"{_SUMMARY} select * exclude (drivers, first_issue) from su"
ORACLE_SQL["brief_text"] = f"""{_SUMMARY}, w as (select *, case direction when 'increase' then 'rise by ' when 'decrease' then 'fall by ' end as verb, printf('%.1f%%', round(abs(coalesce(percent, 0)), 1)) as pct, printf('%.0f', round(mean_lower)) as low, printf('%.0f', round(mean_upper)) as high,
  array_to_string([split_part(x, '=', 1) for x in string_split(drivers, ',') if x like '%=positive'], ', ') as plus, array_to_string([split_part(x, '=', 1) for x in string_split(drivers, ',') if x like '%=negative'], ', ') as minus from su)
select series_id, 'Over the next ' || horizon || ' periods the target ' || case when verb is null then 'is expected to stay about level' else 'is expected to ' || verb || pct end || ', between ' || low || ' and ' || high || ' on average. The forecast comes from ' || best_model || coalesce(printf(', whose error in backtests was %.1f%%', round(smape, 1)), '') || '.' as executive_summary,
  concat_ws(' ', case when plus <> '' then 'Pushing up: ' || plus || '.' end, case when minus <> '' then 'Pulling down: ' || minus || '.' end, case when plus = '' and minus = '' then 'No strong driver stands out.' end, case when detected then 'The series has a ' || seasonality_type || ' season.' end) as drivers_text,
  concat_ws(' ', printf('Data quality scores %d of 100.', quality_score), 'First issue: ' || first_issue || '.', case when abs((mean_upper - mean_lower) / mean_yhat) > 0.5 then 'The range is wide, so plans need slack.' end) as risks,
  case direction when 'increase' then 'Prepare for higher demand and check capacity early.' when 'decrease' then 'Plan for lower demand and avoid excess stock.' else 'Keep the present plan and watch for change.' end || ' Plan for values from ' || low || ' to ' || high || '.' as recommendation, 'rules' as generated_by from w"""
_U = lambda k: f"((('0x' || substr(md5('42:0:' || i || ':{k}'), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double)"
ORACLE_SQL["sample_generator"] = f"""with r as (select i, date '2021-01-01' + cast(i as int) as date from (select unnest(range(1095)) as i)),
  v as (select i, date, greatest(800 + 120 * i / 365.0::double + 140 * sin(2 * pi() * i / 365.0::double + 1) + case when isodow(date) < 6 then 40 * sin((isodow(date) - 1) * pi() / 5) + 30 else -120 end + 25 * sin(2 * pi() * (day(date) - 1) / 30.0::double)
    + case when month(date) = 11 then 180 else 0 end + sqrt(-2 * ln({_U(1)})) * cos(2 * pi() * {_U(2)}) * 55, 100) as value from r)
  select date, round(greatest(value + case when {_U(3)} < 0.015::double then case when {_U(4)} < 0.5 then -1 else 1 end * (250 + 250 * {_U(5)}) else 0 end, 100), 2) as target from v"""
_SERVED = "('events', 'lineitem', 'orders')"
_IS_NUMBER = "(data_type in ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') or data_type like 'DECIMAL%')"
ORACLE_SQL["column_inference"] = f"""select table_name as dataset, min_by(column_name, ordinal_position) filter (data_type like 'TIMESTAMP%' or data_type = 'DATE') as date_col,
  min_by(column_name, ordinal_position) filter ({_IS_NUMBER}) as target_col, string_agg(column_name, ',' order by ordinal_position) filter ({_IS_NUMBER}) as numeric_cols from information_schema.columns where table_name in {_SERVED} group by 1"""
ORACLE_SQL["dataset_catalog"] = " union all ".join(f"select '{t}' as dataset, count(*) as n_rows, (select count(*) from information_schema.columns where table_name = '{t}') as n_columns from {t}" for t in ("events", "lineitem", "orders"))

# Series of any length: every event by its time
EVENTS = "o as (select 'all' as series_id, ts, cast(sum(cast(round(value, 2) as decimal(18,2))) as double) as y from events group by 2)"
ORACLE_SQL["long_rolling"] = f"with {EVENTS} select series_id, ts, " + ", ".join(_rolled(a, w, min(w, 14), f"rolling_{s}_{w}", 6) for w in (7, 28) for s, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " from o"
ORACLE_SQL["long_features"] = f"""with {EVENTS}, r as (select *, case when count(y) {_ROLL(7)} >= 7 then avg(y) {_ROLL(7)} end as m7 from o), p as (select *, lag(m7) over (partition by series_id order by ts) as b from r)
    select series_id, ts, {", ".join(f"lag(y, {k}) over (partition by series_id order by ts) as lag_{k}" for k in (1, 7, 365))}, {_rolled("avg", 7, 7, "rolling_mean_7", 6)}, {_rolled("avg", 90, 14, "rolling_mean_90", 6)}, round(case when b <> 0 then m7 / b - 1 when m7 <> 0 then sign(m7) * 'inf'::double end, 6) as momentum from p"""
ORACLE_SQL["long_rolling_mad"] = f"""with {EVENTS}, r as (select *, case when count(y) {_ROLL(28)} >= 14 then median(y) {_ROLL(28)} end as med from o), a as (select *, abs(y - med) as off from r), b as (select *, case when count(off) {_ROLL(28)} >= 14 then median(off) {_ROLL(28)} end as mad from a)
    select series_id, ts, y, {rounded("med", "mad", digits=6)}, coalesce(off > 3 * 1.4826 * nullif(mad, 0), false) as is_anomaly from b"""
ORACLE_SQL["long_quantiles"] = "select l_returnflag as series_id, count(*) as n, " + ", ".join(f"round(quantile_cont(l_extendedprice, 0.{k}), 6) as q{k}" for k in ("01", "25", "50", "75", "99")) + " from lineitem group by 1"
ORACLE_SQL["long_summary"] = ORACLE_SQL["summary_stats"].replace(PRIORITY, EVENTS)
ORACLE_SQL["long_iqr"] = f"with {EVENTS}, {PLACED}, {QUARTILES} select series_id, ts, y, round(q1 - 1.5 * (q3 - q1), 6) as low, round(q3 + 1.5 * (q3 - q1), 6) as high, q3 > q1 and (y < q1 - 1.5 * (q3 - q1) or y > q3 + 1.5 * (q3 - q1)) as is_anomaly from s join q using (series_id)"


def smoothed(windows: str) -> str:
    """CTEs up to `ets`: forecasts (series_id, fold, h, train_end, yhat, half) of each row series_id, fold, train_end, size, p, y (list) of a
    relation.  The grid is a relation of rows here, one fold over the values for each of them."""
    e = "(x.y - (s.level + s.slope) - s.season[1])"
    state = f"{{'level': s.level + s.slope + a * {e}, 'slope': s.slope + a * b * {e}, 'season': list_append(s.season[2:], s.season[1] + g * {e}), 'e': s.e + {e}, 'ee': s.ee + {e} * {e}, 'y': x.y}}"
    fold = f"list_reduce(items, lambda s, x: {state})"
    mean = lambda part: f"list_sum({part}) / p"
    first = f"""case when p > 0 then {{'level': {mean("y[1:p]")}, 'slope': ({mean("y[p + 1:2 * p]")} - {mean("y[1:p]")}) / p, 'season': [v - {mean("y[1:p]")} for v in y[1:p]], 'e': 0.0::double, 'ee': 0.0::double, 'y': 0.0::double}}
        else {{'level': y[1], 'slope': coalesce(y[2] - y[1], 0), 'season': [0.0::double], 'e': 0.0::double, 'ee': 0.0::double, 'y': 0.0::double}} end"""
    lits = lambda xs: "[" + ", ".join(f"{x}::double" for x in xs) + "]"
    around = lambda c, f: f"unnest([{c} / {f}::double, {c}, least({c} * {f}::double, {TOP}::double)]) as {c}"
    out = f"""w0 as (select *, {first} as first from ({windows})),
w1 as (select series_id, fold, train_end, size, p, list_prepend(first, [{{'level': 0.0::double, 'slope': 0.0::double, 'season': []::double[], 'e': 0.0::double, 'ee': 0.0::double, 'y': v}} for v in y]) as items from w0),
g0 as (select series_id, fold, a, b, g from w1, (select unnest({lits(LEVELS)}) as a), (select unnest({lits(TRENDS)}) as b), (select unnest({lits(SEASONALS)}) as g) where p > 0
  union all select series_id, fold, a, b, 0.0::double from w1, (select unnest({lits(LEVELS)}) as a), (select unnest({lits(TRENDS)}) as b) where p = 0),"""
    for k in range(len(FACTORS) + 1):
        out += f"\nb{k} as (select series_id, fold, min({{'ee': ee, 'a': a, 'b': b, 'g': g}}) as w from (select series_id, fold, a, b, g, {fold}.ee as ee from g{k} join w1 using (series_id, fold)) group by 1, 2),"
        if k < len(FACTORS):
            part = f"select series_id, fold, {around('a', FACTORS[k])}, b, g from (select series_id, fold, w.a as a, w.b as b, w.g as g from b{k})"
            part = f"select series_id, fold, a, {around('b', FACTORS[k])}, g from ({part})"
            out += f"\ng{k + 1} as (select distinct series_id, fold, a, b, {around('g', FACTORS[k])} from ({part})),"
    return out + f"""
fin0 as (select *, {fold} as s from (select w1.*, w.a as a, w.b as b, w.g as g from w1 join b{len(FACTORS)} using (series_id, fold))),
ets as (select series_id, fold, h, train_end, s.level + s.slope * h + s.season[(h - 1) % len(s.season) + 1] as yhat, 1.96 * sqrt(greatest(s.ee / train_end - pow(s.e / train_end, 2), 0)) * sqrt(h) as half
  from fin0, lateral (select unnest(range(1, size + 1)) as h) u)"""


_EVERY = "[" + ", ".join(map(str, SUPPORTED)) + "]"
ETS_WINDOWS = f"""select f.series_id, fold, train_end, size, l.ys[1:train_end] as y, coalesce([p for p in list_sort(list_intersect(coalesce(periods, []), {_EVERY})) || case when len(periods) > 0 then {_EVERY} else [] end if train_end >= 3 * p][1], 0) as p
  from folds f join (select series_id, list(y order by t) as ys from s group by 1) l using (series_id) left join (select series_id, list(period) as periods from ok group by 1) d using (series_id)"""
ORACLE_SQL["ets_backtest"] = f"""{detected(PRIORITY)}, {FOLDS}, {smoothed(ETS_WINDOWS)}, naive as (select series_id, 'ets' as model, fold, h, train_end, yhat from ets), snaive as (select * from naive where false), {SCORES}
select series_id, model, fold, {rounded("mae", "rmse", "mape", "smape", "wape")}, n from scores"""


# The service functions: two baselines, the seasonal one with the detected season
def _baselines(steps: str, tag: str = "") -> str:
    return f"""naive{tag} as (select p.series_id, 'naive' as model, p.fold, p.h, p.train_end, g.y as yhat, g.y - 1.96 * g.sigma * sqrt(p.h) as lower, g.y + 1.96 * g.sigma * sqrt(p.h) as upper from {steps} p join g on g.series_id = p.series_id and g.t = p.train_end - 1),
snaive{tag} as (select p.series_id, 'seasonal_naive' as model, p.fold, p.h, p.train_end, b.y as yhat, b.y - 1.96 * e.sigma * sqrt(p.h) as lower, b.y + 1.96 * e.sigma * sqrt(p.h) as upper
  from {steps} p join ls using (series_id) join s b on b.series_id = p.series_id and b.t = case when p.train_end >= L then p.train_end - L + (p.h - 1) % L else p.train_end - 1 end join e on e.series_id = p.series_id and e.t = p.train_end - 1)"""


_SPREADS = """d as (select *, y - lag(y) over (partition by series_id order by t) as d1 from s), g as (select *, coalesce(stddev_pop(d1) over (partition by series_id order by t), 0) as sigma from d),
ls as (select series_id, coalesce(period, 7) as L from season),
e as (select a.series_id, a.t, coalesce(stddev_pop(a.y - b.y) over (partition by a.series_id order by a.t), 0) as sigma from s a join ls using (series_id) left join s b on a.series_id = b.series_id and b.t = a.t - L)"""
_SERVED_BOARD = f"{detected(PRIORITY)}, {_SPREADS}, {FOLDS}, {STEPS}, {_baselines('steps')}, {SCORES}, {BOARD}"
_SERVED_FINAL = f"""{_SERVED_BOARD}, ahead as (select series_id, 0 as fold, max(n) as train_end, unnest(range(1, 15)) as h from s group by 1), {_baselines("ahead", "_ahead")},
ends as (select series_id, max(n) as n, arg_max(y, ts) as last_y, max(ts) as last_ts from s group by 1),
final as (select f.*, cast(last_ts + cast(h as int) as date) as ds from (select * from naive_ahead union all select * from snaive_ahead) f join board b on b.series_id = f.series_id and b.model = f.model and b.is_best join ends on ends.series_id = f.series_id)"""
_RECENT_DRIVERS = DRIVERS.replace("case when z.detected then ',seasonality=positive' else '' end", "case when z.detected then ',seasonality=' || case when z.strength > 0.3 then 'positive' else 'neutral' end else '' end").replace("else 'neutral' end as drivers", "else 'neutral' end || ',recent value=neutral' as drivers")
ORACLE_SQL["service_validate"] = f"""with {PRIORITY}, {PLACED}, pr as (select series_id, count(*) as n, min(ts) as a, max(ts) as b, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3, min(y) = max(y) as constant from s group by 1),
  ou as (select series_id, count(*) filter (q3 > q1 and (y < q1 - 3 * (q3 - q1) or y > q3 + 3 * (q3 - q1))) as outliers from s join pr using (series_id) group by 1),
  z as (select pr.*, outliers, frequency, case when frequency = 'D' and n < 0.95 * (date_diff('day', a, b) + 1) then date_diff('day', a, b) + 1 - n else 0 end as missing_days from pr join ou using (series_id) join {frequencies("s")} f using (series_id))
  select series_id, n as rows_in, n, frequency, missing_days, outliers, 100 - {_OFF("missing_days > 0", "gaps")} - {_OFF("frequency = 'IR'", "irregular")} - {_OFF("outliers > 0", "outliers")} - {_OFF("constant", "constant")} as score, true as is_valid from z"""
ORACLE_SQL["service_explore"] = f"""{detected(PRIORITY)}, {trend()}, {VOLATILITY}, {QUARTILES}, an as (select series_id, count(*) filter (q3 > q1 and (y < q1 - 3 * (q3 - q1) or y > q3 + 3 * (q3 - q1))) as n_anomalies from s join q using (series_id) group by 1),
  st2 as (select series_id, round(avg(y), 3) as mean, round(median(y), 3) as median from s group by 1), dl as (select series_id, round(arg_max(trend, t), 3) as trend_last from dec_7 group by 1)
  select series_id, st2.mean, median, trend_last, trend.direction as trend, vol.level as volatility, detected, n_anomalies from st2 left join dl using (series_id) join trend using (series_id) join vol using (series_id) join season using (series_id) join an using (series_id)"""
ORACLE_SQL["service_train"] = f"""{detected(PRIORITY)}, {_SPREADS}, folds as (select series_id, 1 as fold, max(n) - least(7, greatest(1, cast(floor(max(n) * 0.1) as int))) as train_end, least(7, greatest(1, cast(floor(max(n) * 0.1) as int))) as size from s group by 1),
  {STEPS}, {_baselines("steps")}, {SCORES} select series_id, model, round(mae, 4) as holdout_mae, cast(null as varchar) as error from scores"""
ORACLE_SQL["service_evaluate"] = f"{_SERVED_BOARD} select series_id, model, mae, rmse, mape, smape, wape, n_folds_valid, rank, n_folds_total, is_best from board"
ORACLE_SQL["service_forecast"] = f"{_SERVED_FINAL} select series_id, model, h, ds, {rounded('yhat', 'lower', 'upper', digits=3)} from final"
ORACLE_SQL["service_explain"] = f"{detected(PRIORITY)}, {trend()}, {VOLATILITY}, {_RECENT_DRIVERS} select * from drv"
_SERVED_SUMMARY = _SUMMARY[_SUMMARY.index("fin as (") :].replace(DRIVERS, _RECENT_DRIVERS)
ORACLE_SQL["service_recommend"] = ORACLE_SQL["brief_text"].replace(_SUMMARY, f"{_SERVED_FINAL}, {trend()}, {_SERVED_SUMMARY}")
ORACLE_SQL["service_upload"] = f"with {ORDERS} select ts, y from o"
ORACLE_SQL["csv_round_trip"] = "select event_type as series_id, count(*) as n, round(cast(sum(cast(round(v, 2) as decimal(18,2))) as double), 2) as total from (select event_type, ts, arg_max(value, event_id) as v from events group by 1, 2) group by 1"
ORACLE_SQL["catalogue_versions"] = "select event_type, count(*) as n, 1 as version from events where event_id % 2 = 0 group by 1 union all select event_type, count(*), 2 from events group by 1"
ORACLE_SQL["future_calendar"] = f"""with {PRIORITY}, l as (select series_id, max(ts) as d from o group by 1), g as (select series_id, h, cast(d + cast(h as int) as date) as ds from l, (select unnest(range(1, 15)) as h))
  select series_id, h, ds, year(ds) as year, month(ds) as month, quarter(ds) as quarter, week(ds) as week, isodow(ds) - 1 as dayofweek, cast(isodow(ds) >= 6 as int) as is_weekend, day(last_day(ds)) as days_in_month, dayofyear(ds) as day_of_year,
  round(sin(2 * pi() * (isodow(ds) - 1) / 7), 6) as sin_week, round(cos(2 * pi() * month(ds) / 12), 6) as cos_month from g"""
ORACLE_SQL["summary_numbers"] = f"""{BACKTEST}, {trend()}, {VOLATILITY} select board.series_id, board.model as best_model, board.mae, board.rmse, board.mape, board.smape, board.wape, round(round(slope, 6), 3) + 0.0 as trend_slope, round(round(slope / mean * 100, 4), 3) + 0.0 as trend_slope_pct,
  {{p_value}} as trend_p_value, round(round(overall, 4), 3) as volatility_overall, round(round(early, 4), 3) as volatility_early, round(round(recent, 4), 3) as volatility_recent, round(round(ratio, 4), 3) as volatility_ratio from board join trend using (series_id) join vol using (series_id) where is_best"""
# Two-sided tail of Student's t for many rows: the normal tail at the expansion of t around it (Fisher), of which three terms give four places
_Z = "(abs(t_stat) * (1 - 1 / (4.0::double * (n - 2))) / sqrt(1 + t_stat * t_stat / (2.0::double * (n - 2))))"
_T = f"(1 / (1 + 0.3275911::double * {_Z} / sqrt(2)))"
_TAIL = f"({_T} * (0.254829592::double + {_T} * (-0.284496736::double + {_T} * (1.421413741::double + {_T} * (-1.453152027::double + {_T} * 1.061405429::double)))) * exp(-{_Z} * {_Z} / 2))"
ORACLE_SQL["summary_numbers"] = ORACLE_SQL["summary_numbers"].replace("{p_value}", f"round({_TAIL}, 3)")
