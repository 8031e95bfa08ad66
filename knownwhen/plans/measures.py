"""Benchmark, statistic, attribution and audit queries."""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions import statistics as st
from knownwhen.operators import audits, calendars, executions, market
from knownwhen.operators import metrics as mt
from knownwhen.plans.catalog import query
from knownwhen.plans.execution import nav, splits
from knownwhen.plans.series import tr
from knownwhen.plans.store import delay
from knownwhen.plans.views import SQL_VIEWS
from knownwhen.session import materialise

PRIMARY, CASH = "LARGE", "STANDARD"
RESAMPLES = 2000

SQL_VIEWS["shared_levels"] = f"""
select t.entity_id, t.session, t.tr_index, p.tr_index as primary_level, c.tr_index as cash_level from tr_points t
join tr_points p on p.session = t.session and p.entity_id = '{PRIMARY}' join tr_points c on c.session = t.session and c.entity_id = '{CASH}'"""
SQL_VIEWS["cash_levels"] = f"""
select t.entity_id, t.session, t.tr_index, c.tr_index as cash_level from tr_points t
join tr_points c on c.session = t.session and c.entity_id = '{CASH}'"""
SQL_VIEWS["expected_idx"] = """
select session, row_number() over (order by session) as idx from (select distinct session from tr_points)"""
SQL_VIEWS["paired"] = """
select entity_id, session, tr_index / pt - cash_level / pc as strategy, primary_level / pp - cash_level / pc as benchmark from (
  select s.*, e.idx - lag(e.idx) over w as gap, lag(tr_index) over w as pt, lag(primary_level) over w as pp, lag(cash_level) over w as pc
  from shared_levels s join expected_idx e using (session) window w as (partition by entity_id order by session)) where gap = 1"""


def _mix(x):
    for add in (104729, 611953):
        y = f"(({x} + {add}) % {st.PRIME})"
        x = f"(({y} * {y} % {st.PRIME}) * ({y} * {y} % {st.PRIME}) % {st.PRIME} * {y} % {st.PRIME})"
    return x


def _boot_view(src, order, block, seed=1):
    """Row numbers of every resample of every series, by the same counter hash."""
    base = f"({seed} * 7919 + r * 1000003) % {st.PRIME}"
    return f"""
select entity_id, r, t, (b0 + t - t0) % n as idx from (
  select *, last_value(case when restart then t end ignore nulls) over w as t0, last_value(case when restart then begin_at end ignore nulls) over w as b0
  from (select entity_id, n, r, t, t = 0 or h1 * {block} < {st.PRIME} as restart, h2 % n as begin_at from (
    select *, {_mix('x1')} as h1, {_mix('x2')} as h2 from (
      select entity_id, n, r, t, ({base} + 2 * t + 1) % {st.PRIME} as x1, ({base} + 2 * t + 2) % {st.PRIME} as x2
      from (select entity_id, count(*) as n from {src} group by 1 having count(*) > 1), range({RESAMPLES}) rs(r), lateral (select unnest(range(n)) as t))))
  window w as (partition by entity_id, r order by t rows unbounded preceding))"""


SQL_VIEWS["paired_rows"] = "select *, row_number() over (partition by entity_id order by session) - 1 as i from paired"
SQL_VIEWS["boot_paired"] = _boot_view("paired", "session", 21)
SQL_VIEWS["boot_stats"] = """
select entity_id, r, avg(strategy) as m, case when stddev_samp(strategy) > 0 then avg(strategy) / stddev_samp(strategy) * sqrt(252) else 0 end
  - case when stddev_samp(benchmark) > 0 then avg(benchmark) / stddev_samp(benchmark) * sqrt(252) else 0 end as d
from boot_paired b join paired_rows p using (entity_id) where p.i = b.idx group by 1, 2"""


def _interval(v):
    return (
        f"select entity_id, avg({v}) as boot_mean, quantile_cont({v}, 0.05) as lower, quantile_cont({v}, 0.95) as upper, "
        f"quantile_cont({v}, 0.05) > 0 or quantile_cont({v}, 0.95) < 0 as excludes_zero from boot_stats group by 1"
    )


def levels(t, *names):
    s = materialise(tr(t))
    legs = {"primary_level": mt.leg(s, PRIMARY, "primary_level"), "cash_level": mt.leg(s, CASH, "cash_level")}
    return mt.common_levels(s, *[legs[n] for n in names])


def logged(blend):
    """Daily means of unrelated prices swing so much that only the log of a blend is readable."""
    return blend.withColumn("log_index", F.ln("blend_index"))


def expected(s):
    days = s.select("session").distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("session")).cast("bigint"))


def paired(t):
    s = materialise(tr(t))
    shared = mt.common_levels(s, mt.leg(s, PRIMARY, "primary_level"), mt.leg(s, CASH, "cash_level"))
    return mt.sharpe_inputs(shared, expected(s))


@query(
    "common_sessions", "entity_id:s n:i first:d last:d",
    "select entity_id, count(*) as n, min(session) as first, max(session) as last from shared_levels group by 1",
)
def _(t):
    x = levels(t, "primary_level", "cash_level")
    return x.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first"), F.max("session").alias("last"))


SQL_VIEWS["blends"] = """
select entity_id, session, product(coalesce(1 + 0.6 * (tr_index / pt - 1) + 0.4 * (cash_level / pc - 1), 1)) over (partition by entity_id order by session
  rows unbounded preceding) as blend_index, product(coalesce(1 + 0.999 * (tr_index / pt - 1) + 0.001 * (cash_level / pc - 1), 1)) over (partition by entity_id
  order by session rows unbounded preceding) as near_index from (select *, lag(tr_index) over w as pt, lag(cash_level) over w as pc from cash_levels
  window w as (partition by entity_id order by session))"""


@query("blend_series", "entity_id:s session:d log_index:f7", "select entity_id, session, ln(blend_index) as log_index from blends")
def _(t):
    return logged(mt.blend_series(levels(t, "cash_level"), F.lit(0.6)))


@query(
    "exposure_matched_series", "entity_id:s session:d log_index:f7",
    """select entity_id, session, ln(product(coalesce(1 + w * (tr_index / pt - 1) + (1 - w) * (cash_level / pc - 1), 1)) over (partition by entity_id
         order by session rows unbounded preceding)) as log_index from (select *, (month(session) % 5) / 4.0 as w, lag(tr_index) over x as pt,
         lag(cash_level) over x as pc from cash_levels window x as (partition by entity_id order by session))""",
)
def _(t):
    return logged(mt.blend_series(levels(t, "cash_level"), F.month("session") % 5 / 4.0))


@query(
    "equal_exposure_approx", "entity_id:s session:d log_index:f7",
    """with a as (select entity_id, avg((month(session) % 5) / 4.0) as w from cash_levels group by 1)
       select entity_id, session, ln(product(coalesce(1 + w * (tr_index / pt - 1) + (1 - w) * (cash_level / pc - 1), 1)) over (partition by entity_id
         order by session rows unbounded preceding)) as log_index from (select *, lag(tr_index) over x as pt,
         lag(cash_level) over x as pc from cash_levels join a using (entity_id) window x as (partition by entity_id order by session))""",
)
def _(t):
    x = levels(t, "cash_level")
    avg = F.avg(F.month("session") % 5 / 4.0).over(Window.partitionBy("entity_id"))
    return logged(mt.blend_series(x.withColumn("w", avg), F.col("w")))


SQL_VIEWS["target_decisions"] = """
select e.entity_id, decision_session, (cast(strftime(decision_session, '%W') as int) // 3 % 4) / 4.0 as weight
from (select max(session) as decision_session from sessions group by date_trunc('week', session)) cross join (select distinct entity_id from bars) e"""
SQL_VIEWS["tradable_bars"] = "select *, volume % 9 <> 0 as tradable from bars"
SQL_VIEWS["activation_rows"] = """
select * from (select *, last_value(case when acquired is not null then weight end ignore nulls) over (partition by entity_id order by decision_session
    rows between unbounded preceding and 1 preceding) as prev from (
  select d.*, b.session is not null as has_bar, case when b.session is not null then
    (select min(session) from tradable_bars x where x.entity_id = d.entity_id and x.session > d.decision_session and tradable) end as acquired
  from target_decisions d left join tradable_bars b on b.entity_id = d.entity_id and b.session = d.decision_session)) where prev is null or weight <> prev"""


def target_decisions(t):
    d = calendars.weekly_decisions(t.sessions).select(F.col("session").alias("decision_session"))
    # Monday-keyed week of the year counted from the first Monday, as in the SQL text.
    day = F.dayofyear("decision_session")
    week = F.floor((day + 6 - F.weekday("decision_session")) / 7)
    d = d.withColumn("weight", F.floor(week / 3) % 4 / 4.0)
    names = F.array(*[F.lit(e) for e in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return d.withColumn("entity_id", F.explode(names))


def tradable_bars(t):
    return t.bars.withColumn("tradable", F.col("volume") % 9 != 0)


@query(
    "activation_instants", "entity_id:s decision_session:d weight:f4 acquired:d issue:s",
    """select entity_id, decision_session, weight, acquired, case when not has_bar then 'NO_BAR_AT_DECISION' when acquired is null then 'NO_TRADABLE_BAR' end as issue
       from activation_rows""",
)
def _(t):
    return mt.activation_instants(target_decisions(t), tradable_bars(t), 1)


# One leg with its own previous point, and the step-by-step index as a recursion over shared sessions.
SQL_VIEWS["legs"] = """
select t.entity_id, t.session, t.tr_index, t.adj_close, t.distribution, b.open, b.close, lag(t.tr_index) over w as last_tr, lag(t.adj_close) over w as last_adj
from tr_points t left join bars b on b.entity_id = t.entity_id and b.session = t.session window w as (partition by t.entity_id order by t.session)"""
SQL_VIEWS["vt_acts"] = """
select entity_id, acquired, weight, coalesce(lag(weight) over (partition by entity_id order by acquired), 0) as running,
  (select min(e.session) from legs e join legs c on c.session = e.session and c.entity_id = 'STANDARD' where e.entity_id = a.entity_id and e.session >= a.acquired) as landed
from activation_rows a where acquired is not null"""
SQL_VIEWS["vt_rows"] = """
select e.entity_id, e.session, row_number() over w as k, lag(e.session) over w as prev, x.idx - lag(x.idx) over w - 1 as skip,
  e.tr_index / lag(e.tr_index) over w as re, c.tr_index / lag(c.tr_index) over w as rc,
  e.last_tr / lag(e.tr_index) over w * (e.open * e.adj_close / e.close + e.distribution) / e.last_adj as eo, e.adj_close / (e.open * e.adj_close / e.close) as ei,
  c.last_tr / lag(c.tr_index) over w * (c.open * c.adj_close / c.close + c.distribution) / c.last_adj as co, c.adj_close / (c.open * c.adj_close / c.close) as ci,
  (select arg_max(weight, acquired) from vt_acts a where a.entity_id = e.entity_id and a.landed = e.session) as at_open,
  coalesce((select bool_or(acquired <> landed and weight <> running) from vt_acts a where a.entity_id = e.entity_id and a.landed = e.session), false) as inside
from legs e join legs c on c.session = e.session and c.entity_id = 'STANDARD' left join sessions x on x.session = e.session
window w as (partition by e.entity_id order by e.session)"""
SQL_VIEWS["vt_index"] = """
select entity_id, k, session, cast(0 as double) as weight_before, coalesce(at_open, 0) as w, cast(1 as double) as level, '' as issues from vt_rows where k = 1
union all
select r.entity_id, r.k, r.session, v.w, coalesce(r.at_open, v.w),
  v.level * case when r.at_open is null or r.at_open = v.w or eo is null or co is null or ei is null or ci is null then v.w * re + (1 - v.w) * rc
    else (v.w * eo + (1 - v.w) * co) * (r.at_open * ei + (1 - r.at_open) * ci) end,
  concat_ws(',', case when inside then 'INSIDE_INTERVAL' end, case when skip > 0 and v.w not in (0, 1) then 'SKIPPED_SESSION' end,
    case when r.at_open <> v.w and (eo is null or co is null or ei is null or ci is null) then 'NO_USABLE_OPEN' end)
from vt_index v join vt_rows r on r.entity_id = v.entity_id and r.k = v.k + 1"""


@query(
    "vol_target_index", "entity_id:s session:d weight_before:f4 log_level:f6 issues:s",
    "select entity_id, session, weight_before, ln(level) as log_level, issues from vt_index",
)
def _(t):
    pts = materialise(market.total_return(t.bars, t.actions, keep=["open", "close"]))
    acts = mt.activation_instants(target_decisions(t), tradable_bars(t), 1).where("acquired is not null")
    cash = pts.where(F.col("entity_id") == CASH)
    out = mt.vol_target_index(pts, cash, acts, t.sessions)
    return out.withColumn("issues", F.array_join("issues", ",")).withColumn("log_level", F.ln("level"))


@query(
    "cagr", "entity_id:s cagr:f7",
    """select entity_id, case when arg_max(tr_index, session) <= 0 then -1 else pow(arg_max(tr_index, session) / arg_min(tr_index, session),
         365.25 / (max(session) - min(session))) - 1 end as cagr from tr_points group by 1""",
)
def _(t):
    return mt.span_cagr(tr(t))


@query(
    "max_drawdown", "entity_id:s max_drawdown:f7",
    """select entity_id, min(tr_index / peak - 1) as max_drawdown from (select *, max(tr_index) over (partition by entity_id order by session
         rows unbounded preceding) as peak from tr_points) group by 1""",
)
def _(t):
    return mt.max_drawdown(tr(t))


@query(
    "annualised_vol_series", "entity_id:s vol:f7",
    "select entity_id, stddev_samp(log_return) * sqrt(252) as vol from tr_returns group by 1",
)
def _(t):
    r = market.returns(tr(t))
    return r.groupBy("entity_id").agg((F.stddev_samp("log_return") * math.sqrt(252)).alias("vol"))


_XS = """select entity_id, tr_index / lag(tr_index) over w - cash_level / lag(cash_level) over w as xc,
  tr_index / lag(tr_index) over w - primary_level / lag(primary_level) over w as xp from shared_levels window w as (partition by entity_id order by session)"""


@query(
    "sharpe", "entity_id:s sharpe:f7",
    f"select entity_id, case when stddev_samp(xc) > 0 then avg(xc) / stddev_samp(xc) * sqrt(252) else 0 end as sharpe from ({_XS}) group by 1",
)
def _(t):
    x = levels(t, "primary_level", "cash_level").withColumn("x", mt.step("tr_index") - mt.step("cash_level"))
    return x.groupBy("entity_id").agg(mt.sharpe(F.col("x")).alias("sharpe"))


@query(
    "information_ratio", "entity_id:s ir:f7",
    f"select entity_id, case when stddev_samp(xp) > 0 then avg(xp) / stddev_samp(xp) * sqrt(252) else 0 end as ir from ({_XS}) group by 1",
)
def _(t):
    x = levels(t, "primary_level", "cash_level").withColumn("x", mt.step("tr_index") - mt.step("primary_level"))
    return x.groupBy("entity_id").agg(mt.sharpe(F.col("x")).alias("ir"))


@query(
    "turnover", "account:i turnover:f6",
    """with n as (select account, avg(nav) as nav, (max(session) - min(session)) / 365.25 as years from nav_rows group by 1),
       t as (select account, sum(price * qty) as traded from fills group by 1)
       select account, traded / (nav * years) as turnover from n join t using (account)""",
)
def _(t):
    trades = t.fills.select("account", (F.col("price") * F.col("qty")).alias("notional"))
    return mt.turnover(trades, nav(t))


@query(
    "arm_metrics",
    "entity_id:s total_return:f6 cagr:f6 volatility:f6 max_drawdown:f6 calmar:f6 sharpe:f6 information_ratio:f6 worst_21:f6 p01:f6 p05:f6 sessions:i",
    """with r as (select t.*, t.tr_index / lag(t.tr_index) over w - 1 as r, t.tr_index / lag(t.tr_index, 21) over w - 1 as roll,
           t.tr_index / max(t.tr_index) over (w rows unbounded preceding) - 1 as dd from tr_points t window w as (partition by entity_id order by session)),
       base as (select entity_id, arg_max(tr_index, session) / arg_min(tr_index, session) - 1 as total_return,
           pow(arg_max(tr_index, session) / arg_min(tr_index, session), 365.25 / (max(session) - min(session))) - 1 as cagr,
           stddev_samp(ln(1 + r)) * sqrt(252) as volatility, min(dd) as max_drawdown, min(roll) as worst_21,
           quantile_cont(r, 0.01) as p01, quantile_cont(r, 0.05) as p05, count(*) as sessions from r group by 1),
       c as (select entity_id, avg(x) / stddev_samp(x) * sqrt(252) as sharpe from (select entity_id, tr_index / lag(tr_index) over w - cash_level / lag(cash_level) over w as x
           from cash_levels window w as (partition by entity_id order by session)) group by 1 having stddev_samp(x) > 0),
       p as (select entity_id, avg(x) / stddev_samp(x) * sqrt(252) as ir from (select t.entity_id, t.tr_index / lag(t.tr_index) over w - p.tr_index / lag(p.tr_index) over w as x
           from tr_points t join tr_points p on p.session = t.session and p.entity_id = 'LARGE' window w as (partition by t.entity_id order by t.session)) group by 1 having stddev_samp(x) > 0)
       select *, cagr / abs(max_drawdown) as calmar, coalesce(sharpe, 0) as sharpe, coalesce(ir, 0) as information_ratio
       from base left join (select entity_id, sharpe as s0 from c) using (entity_id) left join c using (entity_id) left join p using (entity_id)""".replace(
        "select *, cagr", "select base.*, cagr"
    ),
)
def _(t):
    s = materialise(tr(t))
    x = s
    for name, e in (("primary_level", PRIMARY), ("cash_level", CASH)):
        x = x.join(F.broadcast(mt.leg(s, e, name)), "session", "left")
    return mt.arm_metrics(x)


@query(
    "sharpe_input_series", "entity_id:s session:d strategy:f8 benchmark:f8",
    "select entity_id, session, strategy, benchmark from paired",
)
def _(t):
    return paired(t)


@query(
    "tax_scenarios", "account:i scenario:s tax:f0 drag:f6",
    """with r as (select account, coalesce(sum(g) filter (not lt), 0) as s, coalesce(sum(g) filter (lt), 0) as l from (
         select account, units * unit_net - units * unit_cost as g, closed - opened > 365 as lt from fifo) group by 1)
       select account, 'tax_deferred' as scenario, 0 as tax, 0 as drag from r
       union all select account, 'taxable_short_long_split', s * 0.35 + l * 0.15, (s * 0.35 + l * 0.15) / 1e9 from r""",
)
def _(t):
    r = executions.realized_summary(executions.lot_match_fifo(t.fills, splits(t))).where("account is not null")
    return mt.tax_scenarios(r, 1.0e9, 0.35, 0.15)


@query(
    "moments", "entity_id:s n:i mean:f8 sd:f8 skew:f6 kurt:f6",
    """select entity_id, count(*) as n, avg(simple_return) as mean, stddev_samp(simple_return) as sd, skewness(simple_return) as skew,
         kurtosis(simple_return) as kurt from tr_returns group by 1""",
)
def _(t):
    return mt.moments(market.returns(tr(t)), "simple_return")


@query(
    "quantile_linear", "entity_id:s q01:f8 q05:f8 q25:f8 q50:f8",
    """select entity_id, quantile_cont(simple_return, 0.01) as q01, quantile_cont(simple_return, 0.05) as q05, quantile_cont(simple_return, 0.25) as q25,
         quantile_cont(simple_return, 0.5) as q50 from tr_returns group by 1""",
)
def _(t):
    return mt.quantiles(market.returns(tr(t)), "simple_return", (0.01, 0.05, 0.25, 0.5))


_BOOT = "entity_id:s boot_mean:f8 lower:f8 upper:f8 excludes_zero:b"


@query("block_bootstrap", _BOOT, _interval("m"))
def _(t):
    return mt.block_bootstrap(paired(t), ["strategy"], "mean", resamples=RESAMPLES)


@query("block_bootstrap_paired", _BOOT, _interval("d"))
def _(t):
    return mt.block_bootstrap(paired(t), ["strategy", "benchmark"], "sharpe", resamples=RESAMPLES)


def _poly(cs, x):
    out = "0"
    for k in cs:
        out = f"({out} * {x} + {k!r})"
    return out


def _quantile_sql(p):
    def tail(q):
        s = f"sqrt(-2 * ln({q}))"
        return f"({_poly(st.TAIL_NUM, s)} / ({_poly(st.TAIL_DEN, s)} * {s} + 1))"

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"({_poly(st.CENTRAL_NUM, r)} * {q} / ({_poly(st.CENTRAL_DEN, r)} * {r} + 1))"
    return f"case when {p} > 0.97575 then -{tail(f'(1 - {p})')} when {p} < 0.02425 then {tail(p)} else {mid} end"


def _cdf_sql(z):
    t = f"(1 / (1 + {st.ERF_T} * abs({z}) / sqrt(2)))"
    return f"(0.5 * (1 + sign({z}) * (1 - {_poly(st.ERF, t)} * {t} * exp(-({z}) * ({z}) / 2))))"


@query(
    "deflated_sharpe", "trial:i sharpe:f6 expected_max:f6 deflated:f6 notes:s",
    f"""with r as (select l_suppkey as trial, cast(l_shipdate as date) as d, sum(cast(round(l_discount * 100) as bigint)) * 1.0 / count(*) / 100 - 0.05 as x
         from lineitem group by 1, 2),
       m as (select trial, count(*) as n, case when stddev_samp(x) > 0 then avg(x) / stddev_samp(x) * sqrt(252) else 0 end as sharpe,
         skewness(x) as skew, kurtosis(x) as kurt from r group by 1),
       a as (select count(*) as trials, stddev_samp(sharpe) as sd from m),
       j as (select *, case when trials < 2 or n < 60 or coalesce(sd <= 0, true) or abs(kurt) > 10 then concat_ws(',', case when trials < 2 then 'FEWER_THAN_TWO_TRIALS' end,
           case when n < 60 then 'TOO_FEW_OBSERVATIONS' end, case when coalesce(sd <= 0, true) then 'NO_DISPERSION' end, case when abs(kurt) > 10 then 'KURTOSIS_OUT_OF_RANGE' end)
         else '' end as notes from m, a),
       b as (select *, case when notes = '' then sd * (0.42278433509846713 * ({_quantile_sql('(1 - 1.0 / trials)')}) + 0.5772156649015329 * ({_quantile_sql('(1 - 1 / (trials * exp(1)))')})) end as expected_max from j),
       z as (select *, (sharpe - expected_max) / sqrt(252) / sqrt((1 - skew * sharpe / sqrt(252) + kurt / 4 * sharpe * sharpe / 252) / (n - 1)) as z from b)
       select trial, sharpe, expected_max, {_cdf_sql('z')} as deflated, notes from z""",
)
def _(t):
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
    day = t.lineitem.groupBy(F.col("l_suppkey").alias("trial"), F.col("l_shipdate").cast("date").alias("d")).agg(
        (cents / F.count(F.lit(1)) / 100 - 0.05).alias("x")
    )
    m = mt.moments(day, "x", ("trial",))
    m = m.withColumn("sharpe", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * math.sqrt(252)).otherwise(0.0))
    trials = m.agg(F.count(F.lit(1)).alias("trials"), F.stddev_samp("sharpe").alias("trial_sd"))
    rows = m.withColumn("trials", trials.select("trials").scalar()).withColumn("trial_sd", trials.select("trial_sd").scalar())
    return mt.deflated_sharpe(rows).withColumn("notes", F.array_join("notes", ","))


@query(
    "concentration", "strategy:i total:f4 top1:f6 top3:f6 top5:f6 securities:s best_year:i year_share:f6 best_episode:s episode_share:f6 concentrated:b",
    """with c as (select l_suppkey % 20 as strategy, p_brand as security, year(l_shipdate) as year, concat(year(l_shipdate), 'Q', quarter(l_shipdate)) as episode,
           cast(cast(l_extendedprice as decimal(18, 2)) as decimal(20, 2)) * (cast(round(l_discount * 100) as bigint) - 5) as value from lineitem join part on p_partkey = l_partkey),
       s as (select strategy, security, cast(sum(value) as double) / 100 as v, row_number() over (partition by strategy order by sum(value) desc, security) as rk from c group by 1, 2),
       a as (select strategy, sum(v) as total, sum(v) filter (rk <= 1) as t1, sum(v) filter (rk <= 3) as t3, sum(v) filter (rk <= 5) as t5,
           string_agg(security, ',' order by rk) filter (rk <= 5) as securities from s group by 1),
       y as (select strategy, arg_max(year, v) as best_year, max(v) as yv from (select strategy, year, cast(sum(value) as double) / 100 as v from c group by 1, 2) group by 1),
       e as (select strategy, arg_max(episode, v) as best_episode, max(v) as ev from (select strategy, episode, cast(sum(value) as double) / 100 as v from c group by 1, 2) group by 1)
       select strategy, total / 1000000 as total, case when total > 0 then t1 / total else 0 end as top1, case when total > 0 then t3 / total else 0 end as top3,
         case when total > 0 then t5 / total else 0 end as top5, securities, best_year, case when total > 0 then yv / total else 0 end as year_share, best_episode,
         case when total > 0 then ev / total else 0 end as episode_share,
         total > 0 and greatest(t1, yv, ev) / total > 0.4 as concentrated from a join y using (strategy) join e using (strategy)""",
)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("security"))
    pct = F.round(F.col("l_discount") * 100).cast("bigint") - 5
    day = F.col("l_shipdate")
    c = t.lineitem.join(p, "l_partkey").select(
        (F.col("l_suppkey") % 20).alias("strategy"), "security", F.year(day).alias("year"),
        F.concat(F.year(day), F.lit("Q"), F.quarter(day)).alias("episode"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * pct.cast("decimal(4,0)") / 100).cast("decimal(24,4)").alias("value"),
    )
    out = mt.concentration(c)
    return out.withColumn("total", F.col("total").cast("double") / 1000000)


@query(
    "regime_labels", "entity_id:s session:d regime:s",
    """with x as (select *, max(tr_index) over (partition by entity_id order by session rows unbounded preceding) as peak from tr_points),
       y as (select *, 1 - tr_index / peak > 0.1 as deep, (select max(session) from x p where p.entity_id = x.entity_id and p.session <= x.session and p.tr_index >= p.peak) as at_peak from x)
       select entity_id, session, case when deep then 'BENCHMARK_DRAWDOWN' when exists (select 1 from y d where d.entity_id = y.entity_id and d.deep
         and d.session > y.at_peak and d.session < y.session) then 'BENCHMARK_RECOVERY' else 'BENCHMARK_CALM' end as regime from y""",
)
def _(t):
    return mt.regime_labels(tr(t))


@query(
    "exposure_attribution", "entity_id:s timing:f6 selection:f6 cross_term:f9 average_weight:f6 sessions:i",
    """with b as (select s.*, m.near_index as blend_index from shared_levels s join blends m on m.session = s.session and m.entity_id = 'LARGE'),
       r as (select entity_id, arg_max(tr_index, session) / arg_min(tr_index, session) - 1 as s, arg_max(primary_level, session) / arg_min(primary_level, session) - 1 as p,
         arg_max(blend_index, session) / arg_min(blend_index, session) - 1 as m, avg((month(session) % 5) / 4.0) as average_weight, count(*) as sessions from b group by 1)
       select entity_id, m - p as timing, s - m as selection, (s - p) - ((m - p) + (s - m)) as cross_term, average_weight, sessions from r""",
)
def _(t):
    s = materialise(tr(t))
    shared = mt.common_levels(s, mt.leg(s, PRIMARY, "primary_level"), mt.leg(s, CASH, "cash_level"))
    own = mt.common_levels(s.where(F.col("entity_id") == PRIMARY), mt.leg(s, CASH, "cash_level"))
    blend = mt.blend_series(own, F.lit(0.999)).select("session", F.col("blend_index").alias("matched_level"))
    return mt.exposure_attribution(shared.join(F.broadcast(blend), "session"), F.month("session") % 5 / 4.0)


_COV = """select entity_id, count(*) as n, regr_slope(strategy, benchmark) as b, regr_intercept(strategy, benchmark) as a, regr_r2(strategy, benchmark) as r2,
  var_pop(strategy) * count(*) * (1 - regr_r2(strategy, benchmark)) / nullif(count(*) - 2, 0) / (var_pop(benchmark) * count(*)) as vb from paired where entity_id not in ('LARGE', 'STANDARD') group by 1"""


@query(
    "factor_regression", "entity_id:s n:i alpha:f9 beta:f7 r2:f7 beta_t:f4",
    f"""select entity_id, n, case when n > 2 then a end as alpha, case when n > 2 then b end as beta, case when n > 2 then r2 end as r2,
         case when n > 2 then b / sqrt(vb) end as beta_t from ({_COV})""",
)
def _(t):
    out = mt.factor_regression(paired(t).where(~F.col("entity_id").isin(PRIMARY, CASH)), "strategy", ["benchmark"])
    return out.select(
        "entity_id", "n", F.col("coef")[0].alias("alpha"), F.col("coef")[1].alias("beta"), "r2", F.col("t")[1].alias("beta_t")
    )


@query(
    "factor_regression_two", "entity_id:s n:i beta1:f6 beta2:f6 r2:f6",
    """with x as (select p_brand as entity_id, l_extendedprice / 10000 as y, l_quantity as x1, l_discount * 100 as x2 from lineitem join part on p_partkey = l_partkey),
       m as (select entity_id, count(*) as n, covar_samp(x1, y) as s1y, covar_samp(x2, y) as s2y, var_samp(x1) as s11, var_samp(x2) as s22, covar_samp(x1, x2) as s12,
         var_samp(y) as syy from x group by 1)
       select entity_id, n, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as beta1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as beta2,
         ((s22 * s1y - s12 * s2y) * s1y + (s11 * s2y - s12 * s1y) * s2y) / (s11 * s22 - s12 * s12) / syy as r2 from m""",
)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    x = t.lineitem.join(p, "l_partkey").select(
        "entity_id", (F.col("l_extendedprice") / 10000).alias("y"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2")
    )
    out = mt.factor_regression(x, "y", ["x1", "x2"])
    return out.select("entity_id", "n", F.col("coef")[1].alias("beta1"), F.col("coef")[2].alias("beta2"), "r2")


@query("factor_attribution", "entity_id:s n:i alpha:f7 alpha_lower:f7 alpha_upper:f7 r2:f7 status:s")
def _(t):
    p = paired(t)
    month = F.trunc("session", "month").alias("month")
    m = p.groupBy("entity_id", month).agg(
        (F.product(1 + F.col("strategy")) - 1).alias("excess"), (F.product(1 + F.col("benchmark")) - 1).alias("market")
    )
    return mt.factor_attribution(m.where(F.col("entity_id") != PRIMARY), ["market"])


@query(
    "leakage_audit",
    "source_id:s rows:i min_margin_s:f3 non_monotonic_decision_order:i zero_declared_delay:i future_availability:i future_effective_session:i violating_rows:i",
    """with r as (select id, source_id, available_at, effective_at, delay_min as dflt, case when id % 7 = 0 then 0 else delay_min end as d,
           cast(date_trunc('day', available_at) as timestamp) + interval 18 hour + to_hours(cast(id % 11 - 4 as int)) as decision_at from obs),
       x as (select *, max(decision_at) over (partition by source_id order by id rows between unbounded preceding and 1 preceding) as latest,
         epoch_us(decision_at) - epoch_us(available_at + to_minutes(d)) as margin from r),
       v as (select *, decision_at < latest as a, d = 0 and dflt > 0 as b, margin < 0 as c, cast(effective_at as date) > cast(decision_at as date) - 3 as e from x)
       select source_id, count(*) as rows, min(margin) / 1000000.0 as min_margin_s, count(*) filter (a) as non_monotonic_decision_order,
         count(*) filter (b) as zero_declared_delay, count(*) filter (c) as future_availability, count(*) filter (e) as future_effective_session,
         count(*) filter (coalesce(a, false) or b or c or e) as violating_rows from v group by 1""",
)
def _(t):
    hours = F.make_dt_interval(F.lit(0), (F.col("id") % 11 - 4).cast("int"))
    r = t.obs.select(
        F.col("id").alias("read_seq"), "source_id", "available_at", "effective_at",
        F.when(F.col("id") % 7 == 0, F.lit(0)).otherwise(delay()).alias("delay_min"),
        (F.date_trunc("day", "available_at").cast("timestamp_ntz") + F.expr("interval 18 hours") + hours).alias("decision_at"),
    )
    r = r.withColumn("decision_session", F.date_sub(F.col("decision_at").cast("date"), 3))
    return audits.leakage_report(audits.leakage_audit(r, delay()))


@query(
    "coverage_report",
    "entity_id:s first_session:d last_session:d expected:i covered:i interior_gaps:i leading_absent:i trailing_absent:i stale_bars:i codes:s kinds:s blocking:s n_actions:i coverage:f6 status:s",
    """with n as (select count(*) as n from sessions), b as (select b.*, idx, volume % 9 <> 0 as tradable, case when volume % 9 = 0 then 'STALE_BAR' when volume % 50 = 1 then 'GAP' end as flag
         from bars_sparse b join sessions using (session)),
       q as (select distinct p_brand as entity_id, cast(date_trunc('quarter', l_shipdate) as date) as d from lineitem join part on p_partkey = l_partkey),
       a as (select entity_id, case when month(d) = 1 then 'SPLIT' else 'CASH_DIVIDEND' end as kind, case when d = date '1997-04-01' then 'SURVIVORSHIP_BIASED' end as flag from q),
       e as (select distinct p_brand as entity_id from part union select n_name from nation),
       cov as (select entity_id, min(session) as first_session, max(session) as last_session, count(*) as covered, max(idx) - min(idx) + 1 - count(*) as interior_gaps, min(idx) - 1 as lead, max(idx) as hi,
         count(*) filter (not tradable) as stale_bars from b group by 1),
       codes as (select entity_id, string_agg(concat(flag, ':', k), ',' order by concat(flag, ':', k)) as codes from (select entity_id, flag, count(*) as k from b where flag is not null group by 1, 2) group by 1),
       kinds as (select entity_id, string_agg(concat(kind, ':', k), ',' order by concat(kind, ':', k)) as kinds, sum(k) as n_actions from (select entity_id, kind, count(*) as k from a group by 1, 2) group by 1),
       bar as (select entity_id, string_agg(distinct flag, ',' order by flag) as blocking from (select entity_id, flag from a union all select entity_id, flag from b) where flag = 'SURVIVORSHIP_BIASED' group by 1)
       select e.entity_id, first_session, last_session, n as expected, coalesce(covered, 0) as covered, coalesce(interior_gaps, 0) as interior_gaps, coalesce(lead, n) as leading_absent,
         n - coalesce(hi, n) as trailing_absent, coalesce(stale_bars, 0) as stale_bars, coalesce(codes, '') as codes, coalesce(kinds, '') as kinds, coalesce(blocking, '') as blocking,
         coalesce(n_actions, 0) as n_actions, coalesce(covered, 0) / cast(n as double) as coverage,
         case when covered is null then 'UNCOVERED' when covered / cast(n as double) < 0.98 then 'BELOW_MINIMUM' else 'OK' end as status
       from e cross join n left join cov using (entity_id) left join codes using (entity_id) left join kinds using (entity_id) left join bar using (entity_id)""",
)
def _(t):
    v = F.col("volume")
    flag = F.when(v % 9 == 0, "STALE_BAR").when(v % 50 == 1, "GAP")
    b = t.bars_sparse.withColumn("tradable", v % 9 != 0).withColumn("quality_flags", F.array_compact(F.array(flag)))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    acts = t.lineitem.join(p, "l_partkey").select("entity_id", quarter.alias("q")).distinct()
    barred = F.when(F.col("q") == "1997-04-01", F.lit("SURVIVORSHIP_BIASED"))
    acts = acts.select("entity_id", F.when(F.month("q") == 1, "SPLIT").otherwise("CASH_DIVIDEND").alias("kind"), F.array_compact(F.array(barred)).alias("quality_flags"))
    # Nations have no bars: requested entities that nothing covers.
    asked = t.part.select(F.col("p_brand").alias("entity_id")).unionByName(t.nation.select(F.col("n_name").alias("entity_id")))
    out = audits.coverage_report(asked, b, acts, t.sessions)
    return out.withColumns({c: F.array_join(c, ",") for c in ("codes", "kinds", "blocking")})
