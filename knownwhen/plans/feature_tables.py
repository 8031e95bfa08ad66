"""Feature queries at weekly decisions."""

from pyspark.sql import functions as F

from knownwhen.operators import calendars as cal
from knownwhen.operators import features as ft
from knownwhen.plans.catalog import query
from knownwhen.plans.series import bar_rows, month_decisions
from knownwhen.plans.views import ENTITIES, SQL_VIEWS
from knownwhen.session import materialise

P = ft.FeatureParams()
CASH = "STANDARD"

SQL_VIEWS["weekly"] = """
select max(session) as decision_session, max(session) - 435 as load_start from xnys
where session between (select min(session) from bars) and (select max(session) from bars) group by date_trunc('week', session)"""
# Bars and actions as versions: some bars are corrected one to nine days later or after forty, some come days late;
# January's dividends are corrected, July's come late, as do one split and the delisting.
SQL_VIEWS["bar_versions"] = """
select entity_id, session, 2 as ver, close, volume, id, cast(session as timestamp) + interval 21 hour
  + (case when id % 61 = 0 then 1 + id % 9 when id % 211 = 3 then 40 when id % 89 = 5 then 1 + id % 3 else 0 end) * interval 1 day as visible_at from bars
union all select entity_id, session, 1, open, volume + 1, -id, cast(session as timestamp) + interval 21 hour from bars where id % 61 = 0 or id % 211 = 3"""
SQL_VIEWS["action_versions"] = """
select entity_id, kind, effective_date, amount, ratio, 2 as ver, cast(effective_date as timestamp) + interval 12 hour
  + (case when kind = 'DELISTING' then 4 when kind = 'SPLIT' and entity_id = 'PROMO' then 3 when kind = 'SPLIT' then 0
       when month(effective_date) = 1 then 15 when month(effective_date) = 7 then 9 else 0 end) * interval 1 day as visible_at from actions
union all select entity_id, kind, effective_date, 90.0, ratio, 1, cast(effective_date as timestamp) + interval 12 hour
from actions where kind = 'CASH_DIVIDEND' and month(effective_date) = 1"""
SQL_VIEWS["pit_bars"] = """
select w.decision_session, w.load_start, b.* from weekly w join bar_versions b on b.session between w.load_start and w.decision_session
  and b.visible_at <= cast(w.decision_session as timestamp) + interval 22 hour
qualify row_number() over (partition by w.decision_session, entity_id, session order by ver desc) = 1"""
SQL_VIEWS["pit_actions"] = """
select w.decision_session, a.* from weekly w join action_versions a on a.effective_date <= w.decision_session
  and a.visible_at <= cast(w.decision_session as timestamp) + interval 22 hour
qualify row_number() over (partition by w.decision_session, entity_id, kind, effective_date order by ver desc) = 1"""
SQL_VIEWS["pit_live"] = """
select b.*, lag(session) over (partition by b.decision_session, b.entity_id order by session) as prev_session
from pit_bars b left join pit_actions e on e.decision_session = b.decision_session and e.entity_id = b.entity_id and e.kind = 'DELISTING'
where e.effective_date is null or b.session <= e.effective_date"""
SQL_VIEWS["pit_landed"] = """
select l.decision_session, l.entity_id, l.session, product(case when kind = 'SPLIT' then ratio end) as split,
  sum(case when kind = 'CASH_DIVIDEND' then amount end) as dist from pit_live l
join pit_actions a on a.decision_session = l.decision_session and a.entity_id = l.entity_id
  and a.effective_date > l.prev_session and a.effective_date <= l.session group by all"""
SQL_VIEWS["feature_panel"] = """
select *, lead(session) over w as next_session, ln(tr_index / lag(tr_index) over w) as log_return,
  lag(tr_index, 21) over w / lag(tr_index, 252) over w - 1 as mom,
  case when count(*) over (w rows 199 preceding) = 200 then adj_close > avg(adj_close) over (w rows 199 preceding) end as trend,
  case when count(*) over (w rows 19 preceding) = 20 then avg(close * volume) over (w rows 19 preceding) end as adv
from (select *, product(coalesce((adj_close + dist * f) / prev_adj, 1)) over (partition by decision_session, entity_id order by session rows unbounded preceding) as tr_index
  from (select *, close as px, close * f as adj_close, lag(close * f) over (partition by decision_session, entity_id order by session) as prev_adj
    from (select l.*, coalesce(d.dist, 0) as dist, product(coalesce(d.split, 1)) over (partition by l.decision_session, l.entity_id order by l.session rows unbounded preceding) as f
      from pit_live l left join pit_landed d on d.decision_session = l.decision_session and d.entity_id = l.entity_id and d.session = l.session)))
window w as (partition by decision_session, entity_id order by session)"""
SQL_VIEWS["anchors"] = """
select decision_session, load_start, coalesce((select max(session) from feature_panel p where p.decision_session = w.decision_session), decision_session)
  as anchor_session from weekly w"""
SQL_VIEWS["feature_rows"] = """
select decision_session, load_start, anchor_session, entity_id, session, case when ok then mom end as mom,
  case when ok then trend end as trend, case when ok then adv end as adv, case when ok then px end as px,
  case when session is null then 'NO_BAR_AT_DECISION' when not ok then 'STALE_ANCHOR'
    when mom is null or trend is null or adv is null then 'INSUFFICIENT_HISTORY' else '' end as reason
from (select a.*, e.entity_id, p.session, p.mom, p.trend, p.adv, p.px, coalesce(p.session = a.anchor_session, false) as ok from anchors a
  cross join (select distinct entity_id from bars) e
  left join feature_panel p on p.entity_id = e.entity_id and p.decision_session = a.decision_session and p.next_session is null)"""
SQL_VIEWS["cov_members"] = f"""
select * from feature_rows where mom is not null and trend is not null and entity_id <> '{CASH}'"""
SQL_VIEWS["common_sessions_at"] = """
select decision_session, session from (select *, row_number() over (partition by decision_session order by session desc) as rn,
    count(*) over (partition by decision_session) as have from (
  select m.decision_session, p.session from cov_members m join feature_panel p on p.entity_id = m.entity_id
    and p.decision_session = m.decision_session and p.session <= m.anchor_session and p.prev_session >= m.load_start
  group by 1, 2 having count(*) = (select count(*) from cov_members c where c.decision_session = m.decision_session)))
where rn <= 63 and have >= 63"""
SQL_VIEWS["aligned_returns"] = """
select c.decision_session, c.session, m.entity_id, p.log_return from common_sessions_at c
join cov_members m on m.decision_session = c.decision_session
join feature_panel p on p.entity_id = m.entity_id and p.decision_session = c.decision_session and p.session = c.session"""


def weekly(t):
    """Weekly decisions over the data's span; one short table, kept for the query that asks for it twice."""
    if "_weekly" not in t.__dict__:
        if "_daily" in t.__dict__:
            days = t.bars.select("session")
        else:
            days = t.lineitem.where(F.weekday("l_shipdate") < 5).select(F.col("l_shipdate").cast("date").alias("session"))
        span = days.agg(F.min("session").alias("first"), F.max("session").alias("last"))
        week = cal.weekly_decisions(cal.session_calendar(span))
        t.__dict__["_weekly"] = materialise(week.select(F.col("session").alias("decision_session")))
    return t.__dict__["_weekly"]


def members(t, names=ENTITIES):
    return weekly(t).withColumn("entity_id", F.explode(F.array(*[F.lit(e) for e in names])))


def bar_versions(t):
    n = F.col("id")
    days = F.when(n % 61 == 0, 1 + n % 9).when(n % 211 == 3, 40).when(n % 89 == 5, 1 + n % 3).otherwise(0)
    at = F.col("session").cast("timestamp_ntz") + F.expr("interval 21 hours")
    last = F.struct(F.lit(2).alias("ver"), "close", "volume", "id", (at + F.make_dt_interval(days=days.cast("int"))).alias("visible_at"))
    first = F.struct(F.lit(1).alias("ver"), F.col("open").alias("close"), (F.col("volume") + 1).alias("volume"), (-n).alias("id"), at.alias("visible_at"))
    both = F.when((n % 61 == 0) | (n % 211 == 3), F.array(first, last)).otherwise(F.array(last))
    return t.bars.select("entity_id", "session", F.inline(both))


def action_versions(t):
    kind, month = F.col("kind"), F.month("effective_date")
    days = F.when(kind == "DELISTING", 4).when(kind == "SPLIT", F.when(F.col("entity_id") == "PROMO", 3).otherwise(0))
    days = days.when(month == 1, 15).when(month == 7, 9).otherwise(0)
    at = F.col("effective_date").cast("timestamp_ntz") + F.expr("interval 12 hours")
    last = F.struct("amount", F.lit(2).alias("ver"), (at + F.make_dt_interval(days=days)).alias("visible_at"))
    first = F.struct(F.lit(90.0).alias("amount"), F.lit(1).alias("ver"), at.alias("visible_at"))
    both = F.when((kind == "CASH_DIVIDEND") & (month == 1), F.array(first, last)).otherwise(F.array(last))
    return t.actions.select("entity_id", "kind", "effective_date", "ratio", F.inline(both))


def panel(t):
    """What every weekly decision, taken at 22:00, could see; once for a query."""
    if "_pit" not in t.__dict__:
        # Bars and the actions derived from them: the raw lines are read once.
        t.__dict__["_daily"] = t.__dict__["bars"] = materialise(t.bars)
        at = F.col("decision_session").cast("timestamp_ntz") + F.expr("interval 22 hours")
        t.__dict__["_pit"] = ft.pit_panel(bar_versions(t), action_versions(t), weekly(t).withColumn("decision_at", at), P)
    return t.__dict__["_pit"]


def feature_rows(t):
    return ft.features(panel(t), weekly(t), members(t), P)


def aligned(t):
    t.__dict__["_pit"] = panel(t).kept()
    who = ft.eligible(feature_rows(t)).where(F.col("entity_id") != CASH)
    return ft.aligned_returns(panel(t), who, P)


def at_decisions(t, name):
    """A windowed feature at each entity's last bar as every decision saw it."""
    inside = F.col(f"{name}_from") >= ft.load_start(F.col("decision_session"), P)
    return ft.last_seen(panel(t), weekly(t), [name, f"{name}_from"]).where(F.col(name).isNotNull() & inside)


@query(
    "anchor_session",
    "decision_session:d anchor_session:d anchor_from_data:b",
    """select decision_session, coalesce(a, decision_session) as anchor_session, a is not null as anchor_from_data from (
         select decision_session, (select max(session) from bars_sparse b where b.session <= decision_session) as a from weekly)""",
)
def _(t):
    b = t.bars_sparse.withColumn("next_session", F.lead("session").over(ft.by_entity()))
    last = ft.last_bars(b, weekly(t))
    return ft.anchor_sessions(last, weekly(t))


@query(
    "stale_anchor",
    "decision_session:d entity_id:s session:d reason:s",
    "select decision_session, entity_id, session, reason from feature_rows where reason <> ''",
)
def _(t):
    out = feature_rows(t).where(F.size("reasons") > 0)
    return out.withColumn("reason", F.array_join("reasons", ","))


_AT = "select decision_session, entity_id, session, {0} from feature_panel where next_session is null and {0} is not null"


@query("momentum_skip", "decision_session:d entity_id:s session:d mom:f6", _AT.format("mom"))
def _(t):
    return at_decisions(t, "mom")


@query("trend_sma", "decision_session:d entity_id:s session:d trend:b", _AT.format("trend"))
def _(t):
    return at_decisions(t, "trend")


@query("avg_dollar_volume", "decision_session:d entity_id:s session:d adv:f0", _AT.format("adv"))
def _(t):
    return at_decisions(t, "adv")


@query(
    "feature_set",
    "decision_session:d entity_id:s session:d mom:f6 trend:b adv:f0 px:f8",
    "select decision_session, entity_id, session, mom, trend, adv, px from feature_rows",
)
def _(t):
    return feature_rows(t)


@query(
    "cash_hurdle",
    "decision_session:d cash_at_anchor:b cash_mom:f6",
    f"""select decision_session, coalesce(session = anchor_session, false) as cash_at_anchor, mom as cash_mom
        from feature_rows where entity_id = '{CASH}'""",
)
def _(t):
    return ft.cash_hurdle(feature_rows(t), CASH)


@query(
    "common_window",
    "decision_session:d n_members:i first_session:d last_session:d n:i",
    """select decision_session, (select count(*) from cov_members c where c.decision_session = s.decision_session) as n_members,
         min(session) as first_session, max(session) as last_session, count(*) as n from common_sessions_at s group by 1""",
)
def _(t):
    return ft.common_window(aligned(t)).groupBy("decision_session").agg(
        F.max("n_members").alias("n_members"), F.min("session").alias("first_session"), F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "covariance_matrix",
    "decision_session:d a:s b:s cov:f7",
    """select x.decision_session, x.entity_id as a, y.entity_id as b, covar_samp(x.log_return, y.log_return) * 252 as cov
       from aligned_returns x join aligned_returns y on x.decision_session = y.decision_session and x.session = y.session group by 1, 2, 3""",
)
def _(t):
    return ft.covariance_matrix(aligned(t))


@query(
    "annualised_vol",
    "decision_session:d entity_id:s vol:f7",
    "select decision_session, entity_id, sqrt(var_samp(log_return) * 252) as vol from aligned_returns group by 1, 2",
)
def _(t):
    return ft.annualised_vol(aligned(t))


@query(
    "portfolio_vol",
    "decision_session:d portfolio_vol:f7",
    """with n as (select decision_session, count(distinct entity_id) as n from aligned_returns group by 1),
       c as (select x.decision_session, covar_samp(x.log_return, y.log_return) * 252 as cov
         from aligned_returns x join aligned_returns y on x.decision_session = y.decision_session and x.session = y.session
         group by x.decision_session, x.entity_id, y.entity_id)
       select decision_session, sqrt(sum(cov * (0.98 / n) * (0.98 / n))) as portfolio_vol from c join n using (decision_session) group by 1""",
)
def _(t):
    return ft.portfolio_vol(aligned(t).withColumn("weight", F.lit(0.98) / F.col("n_members")))


@query(
    "feature_lineage",
    "decision_session:d entity_id:s n_ids:i min_id:i max_id:i",
    """select f.decision_session, f.entity_id, count(distinct p.id) as n_ids, min(p.id) as min_id, max(p.id) as max_id
       from feature_rows f join feature_panel p on p.entity_id = f.entity_id and p.decision_session = f.decision_session and p.session between f.load_start and f.anchor_session group by 1, 2""",
)
def _(t):
    t.__dict__["_pit"] = panel(t).kept()
    who = feature_rows(t).select("decision_session", "entity_id", "anchor_session")
    out = ft.feature_lineage(panel(t), who, P)
    ids = F.col("observation_ids")
    return out.select(
        "decision_session", "entity_id", F.size(ids).alias("n_ids"), F.array_min(ids).alias("min_id"), F.array_max(ids).alias("max_id")
    )


@query(
    "history_requirement",
    "decision_session:d required_sessions:i load_start:d n_sessions:i",
    """select decision_session, 253 as required_sessions, load_start,
         (select count(*) from sessions s where s.session between load_start and decision_session) as n_sessions from weekly""",
)
def _(t):
    from knownwhen.operators.scan import interval_join

    d = ft.history_requirement(weekly(t), P)
    hit = interval_join(d, t.sessions, [], "load_start", "decision_session", "session", unit="month", closed=True)
    n = hit.groupBy("decision_session").agg(F.count(F.lit(1)).alias("n_sessions"))
    return d.join(n, "decision_session")


@query(
    "features_touched_by_revision",
    "entity_id:s decision_at:t",
    """select distinct entity_id, decision_at from bar_rows join month_decisions
       on cast(session as timestamp) <= decision_at and visible_at > decision_at""",
)
def _(t):
    return ft.touched_by_revision(bar_rows(t), month_decisions(t))
