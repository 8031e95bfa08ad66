"""Market series queries."""

from pyspark.sql import functions as F

from knownwhen.operators import market as m
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS, book_orders

SQL_VIEWS["bar_rows"] = """
select p_type as entity_id, cast(l_shipdate as date) as session, l_linenumber as id,
  cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / count(*) as close, count(*) % 11 = 0 as flagged,
  cast(l_shipdate as date) + interval 21 hour + (l_linenumber - 1) * interval 12 hour as visible_at
from lineitem join part on p_partkey = l_partkey where isodow(l_shipdate) <= 5
group by p_type, cast(l_shipdate as date), l_linenumber"""
SQL_VIEWS["month_decisions"] = """
select distinct date_trunc('month', l_shipdate) + interval 1 month + interval 18 hour as decision_at from lineitem"""
SQL_VIEWS["live_bars"] = """
select b.*, fs, ls from (select b.* from bars b left join actions e on e.entity_id = b.entity_id and e.kind = 'DELISTING'
    where e.effective_date is null or b.session <= e.effective_date) b
join (select b.entity_id, min(session) as fs, max(case when e.effective_date is null or session <= e.effective_date then session end) as ls
  from bars b left join actions e on e.entity_id = b.entity_id and e.kind = 'DELISTING' group by 1) using (entity_id)"""
SQL_VIEWS["adj_bars"] = """
select *, close * f / fend as adj_close from (select b.*,
  coalesce((select product(ratio) from actions a where a.entity_id = b.entity_id and kind = 'SPLIT'
    and effective_date > fs and effective_date <= session), 1) as f,
  coalesce((select product(ratio) from actions a where a.entity_id = b.entity_id and kind = 'SPLIT'
    and effective_date > fs and effective_date <= ls), 1) as fend from live_bars b)"""
SQL_VIEWS["dist_moves"] = """
select entity_id, effective_date as ex_date, amount, target, case when effective_date <= fs then 'before_first'
  when target is null then 'after_last' when target > effective_date then 'moved' else 'applied' end as status
from (select a.*, (select min(session) from live_bars b where b.entity_id = a.entity_id and session >= effective_date) as target,
  (select min(session) from live_bars b where b.entity_id = a.entity_id) as fs from actions a where kind = 'CASH_DIVIDEND')"""
SQL_VIEWS["tr_points"] = """
select *, product(step) over (partition by entity_id order by session rows unbounded preceding) as tr_index from (
  select *, coalesce((adj_close + distribution) / lag(adj_close) over (partition by entity_id order by session), 1) as step from (
    select b.entity_id, b.session, adj_close, coalesce(d.amount, 0) * f / fend as distribution, false as terminal
    from adj_bars b left join (select entity_id, target, sum(amount) as amount from dist_moves
      where status in ('moved', 'applied') group by 1, 2) d on d.entity_id = b.entity_id and d.target = b.session
    union all select a.entity_id, (select max(session) from live_bars b where b.entity_id = a.entity_id) + 1, a.amount, 0, true
    from actions a where kind = 'DELISTING'))"""
SQL_VIEWS["tr_returns"] = """
select *, tr_index / prev - 1 as simple_return, ln(tr_index / prev) as log_return from (
  select *, lag(tr_index) over (partition by entity_id order by session) as prev from tr_points) where prev is not null"""


def bar_rows(t):
    li = t.lineitem.where(F.weekday("l_shipdate") < 5).join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("entity_id")), "l_partkey"
    )
    n = F.count(F.lit(1))
    out = li.groupBy("entity_id", F.col("l_shipdate").cast("date").alias("session"), F.col("l_linenumber").cast("bigint").alias("id")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / n).alias("close"), (n % 11 == 0).alias("flagged")
    )
    at = F.col("session").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(9) + F.col("id").cast("int") * 12)
    flags = F.when(F.col("flagged"), F.array(F.lit("STALE_BAR"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("visible_at", at).withColumn("quality_flags", flags)


def month_decisions(t):
    month = F.add_months(F.trunc(F.col("l_shipdate").cast("date"), "month"), 1).cast("timestamp_ntz")
    return t.lineitem.select((month + F.expr("interval 18 hours")).alias("decision_at")).distinct()


def tr(t):
    return m.total_return(t.bars, t.actions)


@query(
    "load_bars_asof",
    "decision_at:t entity_id:s n:i n_tradable:i close_sum:f6",
    """select decision_at, entity_id, count(*) as n, count(*) filter (not flagged and day(session) <> 13) as n_tradable,
         sum(cast(close as decimal(24, 9))) as close_sum from (
         select *, row_number() over (partition by decision_at, entity_id, session order by id desc) as rn
         from bar_rows join month_decisions on visible_at <= decision_at) where rn = 1 group by all""",
)
def _(t):
    stale = t.bars.where(F.dayofmonth("session") == 13)
    out = m.load_bars(bar_rows(t), month_decisions(t), stale)
    return out.groupBy("decision_at", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tradable").alias("n_tradable"), F.sum(F.col("close").cast("decimal(24,9)")).alias("close_sum")
    )


@query(
    "bar_gaps",
    "entity_id:s session:d gap_flag_session:d",
    """with span as (select entity_id, min(session) as a, max(session) as z from bars_sparse group by 1)
       select p.entity_id, s.session, (select min(session) from bars_sparse b where b.entity_id = p.entity_id
           and b.session > s.session) as gap_flag_session
       from span p join sessions s on s.session between a and z
       where not exists (select 1 from bars_sparse b where b.entity_id = p.entity_id and b.session = s.session)""",
)
def _(t):
    gaps = m.bar_gaps(t.bars_sparse, t.sessions)
    rows = gaps.select("entity_id", "gap_flag_session", F.explode(F.sequence("first_missing", "last_missing")).alias("idx"))
    return rows.join(F.broadcast(t.sessions), "idx")


SQL_VIEWS["action_rows"] = """
select p_type as entity_id, 'CASH_DIVIDEND' as kind, cast(date_trunc('month', l_shipdate) as date) as effective_date,
  min(l_orderkey) * 4 + l_suppkey % 3 as id, avg(l_discount) as amount, case when l_suppkey % 3 = 0 then 'UNVERIFIED_SINGLE_SOURCE'
    else 'AVAILABLE_AT_ESTIMATED' end as flag
from lineitem join part on p_partkey = l_partkey group by p_type, date_trunc('month', l_shipdate), l_suppkey % 3"""


def action_rows(t):
    li = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("entity_id")), "l_partkey")
    src = F.col("l_suppkey") % 3
    out = li.groupBy("entity_id", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("effective_date"), src.alias("src")).agg(
        (F.min("l_orderkey") * 4).alias("k"), F.avg("l_discount").alias("amount")
    )
    flag = F.when(F.col("src") == 0, "UNVERIFIED_SINGLE_SOURCE").otherwise("AVAILABLE_AT_ESTIMATED")
    return out.select(
        "entity_id", F.lit("CASH_DIVIDEND").alias("kind"), "effective_date", (F.col("k") + F.col("src")).alias("id"), "amount",
        F.array(flag).alias("quality_flags"),
    )


@query(
    "dedupe_actions",
    "entity_id:s effective_date:d id:i amount:f8 labels:s",
    """select entity_id, effective_date, id, amount, labels from (select *,
         row_number() over (partition by entity_id, kind, effective_date order by flag = 'UNVERIFIED_SINGLE_SOURCE', id desc) as rn,
         (select string_agg(distinct flag, ',' order by flag) from action_rows b where b.entity_id = a.entity_id
           and b.effective_date = a.effective_date) as labels from action_rows a) where rn = 1""",
)
def _(t):
    return m.dedupe_actions(action_rows(t)).withColumn("labels", F.array_join("labels", ","))


@query("split_adjusted_close", "entity_id:s session:d adj_close:f8", "select entity_id, session, adj_close from adj_bars")
def _(t):
    return m.split_adjusted(t.bars, t.actions)


@query(
    "distributions_to_session",
    "entity_id:s ex_date:d target:d amount:f4 status:s",
    "select entity_id, ex_date, target, amount, status from dist_moves",
)
def _(t):
    return m.distributions_to_session(t.bars, t.actions)


@query(
    "total_return_index",
    "entity_id:s session:d adj_close:f8 distribution:f8 tr_index:f6 terminal:b",
    "select entity_id, session, adj_close, distribution, tr_index, terminal from tr_points",
)
def _(t):
    return tr(t)


@query(
    "terminal_points",
    "entity_id:s session:d adj_close:f8",
    "select entity_id, session, adj_close from tr_points where terminal",
)
def _(t):
    return m.terminal_points(t.bars, t.actions)


@query(
    "simple_returns", "entity_id:s session:d simple_return:f8", "select entity_id, session, simple_return from tr_returns"
)
def _(t):
    return m.returns(tr(t))


@query("log_returns", "entity_id:s session:d log_return:f8", "select entity_id, session, log_return from tr_returns")
def _(t):
    return m.returns(tr(t))


@query(
    "series_asof_point",
    "order_id:i point_session:d point_level:f6",
    """select order_id, p.session as point_session, p.tr_index as point_level from book_orders o
       asof left join tr_points p on p.entity_id = o.entity_id and p.session <= o.decided""",
)
def _(t):
    return m.series_asof(book_orders(t), tr(t), "decided", "point_")


@query(
    "period_return",
    "order_id:i period_return:f6",
    """select order_id, z.tr_index / a.tr_index - 1 as period_return from book_orders o
       asof left join tr_points a on a.entity_id = o.entity_id and a.session <= o.decided
       asof left join tr_points z on z.entity_id = o.entity_id and z.session <= o.decided + 90""",
)
def _(t):
    o = book_orders(t).withColumn("until", F.date_add("decided", 90))
    return m.period_return(o, tr(t), "decided", "until")


@query(
    "monthly_returns",
    "entity_id:s month:d monthly_return:f6",
    """select entity_id, date_trunc('month', session) as month, product(1 + simple_return) - 1 as monthly_return
       from tr_returns group by 1, 2""",
)
def _(t):
    return m.monthly_returns(m.returns(tr(t)))


@query(
    "close_as_of_session",
    "entity_id:s session:d bar_session:d carried_close:f8",
    """select e.entity_id, s.session, b.session as bar_session, b.close as carried_close
       from sessions s cross join (select distinct entity_id from bars_sparse) e
       asof join bars_sparse b on b.entity_id = e.entity_id and b.session <= s.session""",
)
def _(t):
    return m.carry_closes(t.bars_sparse, t.sessions)


@query(
    "distorting_sessions",
    "entity_id:s session:d",
    """with held as (select p_brand as entity_id, year(l_shipdate) as y, cast(min(l_shipdate) as date) as a, cast(max(l_shipdate) as date) as z
         from lineitem join part on p_partkey = l_partkey group by 1, 2)
       select distinct h.entity_id, s.session from held h join sessions s on s.session between a and z
       where not exists (select 1 from bars_sparse b where b.entity_id = h.entity_id and b.session = s.session and volume >= 20)""",
)
def _(t):
    li = t.lineitem.join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id")), "l_partkey"
    )
    held = li.groupBy("entity_id", F.year("l_shipdate").alias("y")).agg(
        F.min(F.col("l_shipdate").cast("date")).alias("held_from"), F.max(F.col("l_shipdate").cast("date")).alias("held_to")
    )
    bars = t.bars_sparse.withColumn("tradable", F.col("volume") >= 20)
    return m.distorting_sessions(held, bars, t.sessions)
