"""Execution, lot and net-asset-value queries."""

from pyspark.sql import functions as F

from knownwhen.operators import executions as ex
from knownwhen.plans.catalog import query
from knownwhen.plans.selection import cand_rows, targets
from knownwhen.plans.views import SQL_VIEWS, book_orders

PART, CASH = 0.5, 1.0e9

SQL_VIEWS["idx_bars"] = """
select *, row_number() over (partition by entity_id order by session) as i, count(*) over (partition by entity_id) as n_bars from bars"""
SQL_VIEWS["order_fills"] = """
select order_id, entity_id, side, decided, quantity, session, ref, decision_close, greatest(0, least(cap, quantity - before)) as filled from (
  select o.*, a.close as decision_close, b.session, b.open as ref, cast(floor(b.volume * 0.5) as bigint) as cap,
    coalesce(sum(cast(floor(b.volume * 0.5) as bigint)) over (partition by order_id order by b.i rows between unbounded preceding and 1 preceding), 0) as before
  from book_orders o asof join idx_bars a on a.entity_id = o.entity_id and a.session <= o.decided
  join idx_bars b on b.entity_id = o.entity_id and b.i between a.i + 1 and a.i + 5) where greatest(0, least(cap, quantity - before)) > 0"""
SQL_VIEWS["costed_fills"] = """
select *, price * filled * 1 / 10000 as fees from (
  select *, ref * (1 + case when side = 'BUY' then 1 else -1 end * 7.0 / 10000) as price from order_fills)"""
SQL_VIEWS["fills_f"] = """
select *, coalesce((select product(ratio) from actions a where a.entity_id = f.entity_id and kind = 'SPLIT' and effective_date <= f.session), 1) as f
from fills f"""
SQL_VIEWS["lots"] = """
select *, sum(qty / f) over (partition by account, entity_id, side order by session, fill_id rows unbounded preceding) as until from fills_f"""
SQL_VIEWS["lot_marks"] = """
select account, entity_id, pos, lead(pos) over (partition by account, entity_id order by pos) as next_pos
from (select distinct account, entity_id, until - qty / f as pos from lots)"""
SQL_VIEWS["bought"] = "select *, until - qty / f as start from lots where side = 'BUY'"
SQL_VIEWS["sold"] = "select *, until - qty / f as start from lots where side = 'SELL'"
SQL_VIEWS["fifo"] = """
select m.account, m.entity_id, b.fill_id as buy_id, s.fill_id as sell_id, b.session as opened, s.session as closed,
  least(b.until, s.until, coalesce(next_pos, b.until)) - pos as units,
  (b.price * b.qty + b.fee) / (b.qty / b.f) as unit_cost, (s.price * s.qty - s.fee) / (s.qty / s.f) as unit_net
from lot_marks m asof join bought b on b.account = m.account and b.entity_id = m.entity_id and b.start <= m.pos
  asof join sold s on s.account = m.account and s.entity_id = m.entity_id and s.start <= m.pos
where least(b.until, s.until) > pos"""
SQL_VIEWS["position_rows"] = """
select account, entity_id, session, case when ended then 0 else q * f end as quantity,
  lead(session) over (partition by account, entity_id order by session) as next_session from (
  select account, entity_id, session, coalesce((select product(ratio) from actions a where a.entity_id = e.entity_id and kind = 'SPLIT'
      and effective_date <= e.session), 1) as f,
    (select sum(case when side = 'BUY' then qty else -qty end / f) from fills_f x where x.account = e.account and x.entity_id = e.entity_id
      and x.session <= e.session) as q,
    exists (select 1 from actions a where a.entity_id = e.entity_id and kind = 'DELISTING' and effective_date <= e.session) as ended
  from (select distinct account, entity_id, session from fills union
    select distinct f.account, f.entity_id, a.effective_date from fills f join actions a on a.entity_id = f.entity_id and kind in ('SPLIT', 'DELISTING')) e)"""
SQL_VIEWS["nav_rows"] = """
select account, s.session, idx, cash, coalesce(market, 0) as market, n_held, n_unpriced,
  case when coalesce(n_unpriced, 0) = 0 then cash + coalesce(market, 0) end as nav
from (select account, min(session) as a from fills group by 1) k join sessions s on s.session >= a
join lateral (select 1e9 + sum(case when side = 'BUY' then -(price * qty + fee) else price * qty - fee end) as cash from fills f
  where f.account = k.account and f.session <= s.session) c on true
left join (select p.account, s.session, sum(p.quantity * b.close) as market, count(*) as n_held, count(*) filter (b.close is null) as n_unpriced
  from sessions s join position_rows p on p.session <= s.session and (p.next_session is null or p.next_session > s.session) and p.quantity <> 0
  asof left join bars b on b.entity_id = p.entity_id and b.session <= s.session group by 1, 2) m using (account, session)"""


def fills_of_orders(t):
    return ex.participation_fill(book_orders(t), t.bars, delay=1, max_bars=5, participation=PART)


def costed(t):
    return ex.fill_cost(fills_of_orders(t), F.lit(2.0), F.lit(5.0), F.lit(1.0))


def splits(t):
    return t.actions.where("kind = 'SPLIT'")


def positions(t):
    return ex.positions_by_session(t.fills, t.actions)


def nav(t):
    gross = F.col("price") * F.col("qty")
    flow = F.when(F.col("side") == "BUY", -(gross + F.col("fee"))).otherwise(gross - F.col("fee"))
    flows = t.fills.select("account", "session", flow.alias("amount"))
    return ex.nav_by_session(positions(t), flows, t.bars, t.sessions, CASH)


@query(
    "participation_fill", "order_id:i session:d filled:i ref:f8",
    "select order_id, session, filled, ref from order_fills",
)
def _(t):
    return fills_of_orders(t)


@query(
    "fill_zero_delay", "order_id:i session:d filled:i",
    """select order_id, session, greatest(0, least(cap, quantity - before)) as filled from (
         select o.*, b.session, cast(floor(b.volume * 0.5) as bigint) as cap,
           coalesce(sum(cast(floor(b.volume * 0.5) as bigint)) over (partition by order_id order by b.i rows between unbounded preceding and 1 preceding), 0) as before
         from book_orders o join idx_bars a on a.entity_id = o.entity_id and a.session = o.decided
         join idx_bars b on b.entity_id = o.entity_id and b.i between a.i and a.i + 5) where greatest(0, least(cap, quantity - before)) > 0""",
)
def _(t):
    return ex.participation_fill(book_orders(t), t.bars, delay=0, max_bars=5, participation=PART)


@query("fill_cost", "order_id:i session:d price:f1 fees:f4", "select order_id, session, price, fees / 1000 as fees from costed_fills")
def _(t):
    return costed(t).withColumn("fees", F.col("fees") / 1000)


@query(
    "execution_shortfall", "order_id:i filled:i shortfall:f0 shortfall_bps:f4",
    """select order_id, sum(filled) as filled, sum(case when side = 'BUY' then 1 else -1 end * (price - decision_close) * filled + fees) as shortfall,
         sum(case when side = 'BUY' then 1 else -1 end * (price - decision_close) * filled + fees) / (max(decision_close) * sum(filled)) * 10000 as shortfall_bps
       from costed_fills group by 1""",
)
def _(t):
    return ex.execution_shortfall(costed(t))


@query(
    "resolve_costs", "order_id:i tier:s half_bps:f4 slip_bps:f4 fee_bps:f4 delay_bars:i",
    """with tiers as (select distinct o_orderpriority as tier, cast(substr(o_orderpriority, 1, 1) as double) as k from orders)
       select order_id, tier, case when entity_id in ('ECONOMY', 'LARGE') and k > 2 then k + length(entity_id) / 10.0 else 2 * k end * 1.5 as half_bps,
         (5 * k + 0.5) * 1.5 as slip_bps, k * 0.1 * 1.5 as fee_bps, cast(k as bigint) % 3 as delay_bars
       from book_orders join orders on o_orderkey = order_id join tiers on tier = o_orderpriority""",
)
def _(t):
    k = F.substring("tier", 1, 1).cast("double")
    tier = t.orders.select(F.col("o_orderpriority").alias("tier")).distinct()
    tiers = tier.select(
        "tier", (k * 0.1).alias("commission_bps"), (k * 5).alias("slippage_bps"), F.lit(0.5).alias("impact_bps"),
        (k.cast("bigint") % 3).alias("delay_bars"),
    )
    named = tier.where(k > 2).withColumn("entity_id", F.explode(F.array(F.lit("ECONOMY"), F.lit("LARGE"))))
    named = named.withColumn("half_spread_bps", k + F.length("entity_id") / 10.0)
    base = tier.select("tier", F.lit("default").alias("entity_id"), (k * 2).alias("half_spread_bps"))
    pri = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("tier"))
    return ex.resolve_costs(book_orders(t).join(pri, "order_id"), tiers, named.unionByName(base), F.lit(1.5))


@query(
    "adv_share_cap", "entity_id:s session:d share_cap:i",
    """select entity_id, session, floor(avg(volume) over (partition by entity_id order by session rows 19 preceding) * 0.5) as share_cap from bars""",
)
def _(t):
    return ex.adv_share_cap(t.bars, 20, 0.5)


@query(
    "fills_before_decision", "fill_id:s n:i",
    """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as fill_id, count(*) as n from lineitem join orders on o_orderkey = l_orderkey
       where cast(l_shipdate as date) <= cast(o_orderdate as date) group by 1""",
)
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("decided"))
    f = t.lineitem.join(o, "l_orderkey").withColumn("session", F.col("l_shipdate").cast("date"))
    out = ex.fills_before_decision(f, 1)
    key = F.concat_ws("-", "l_orderkey", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return out.groupBy(key.alias("fill_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_unit_restatement", "order_id:i session:d session_quantity:f4 decision_price:f7 crossed_split:b",
    """select order_id, session, filled * f as session_quantity, ref * f as decision_price, f <> 1 as crossed_split from (
         select *, coalesce((select product(ratio) from actions a where a.entity_id = o.entity_id and kind = 'SPLIT'
           and effective_date > decided and effective_date <= session), 1) as f from order_fills o)""",
)
def _(t):
    return ex.split_unit_restatement(fills_of_orders(t), splits(t))


@query(
    "gate_suppression", "order_id:i decision:d status:s",
    """select order_id, decided as decision, case when q then case when side = 'BUY' then 'SUPPRESSED_ENTRY' else 'SUPPRESSED_EXIT' end
         when b and side = 'BUY' then 'SUPPRESSED_ENTRY' else 'ACTIONABLE' end as status
       from (select *, count(*) over (partition by decided) % 5 = 0 as q, count(*) over (partition by decided) % 3 = 0 as b from book_orders)""",
)
def _(t):
    o = book_orders(t).withColumnRenamed("decided", "decision")
    n = o.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    v = n.select(
        "decision", F.when(F.col("n") % 5 == 0, "HOLD_ONLY").otherwise("NORMAL").alias("halt_state"), (F.col("n") % 3 != 0).alias("new_risk_allowed")
    )
    return ex.gate_suppression(o.withColumn("delta_shares", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))), v)


@query(
    "frozen_exits", "trial:i decision:i entity_id:s",
    """select trial, decision, entity_id from cand_rows where held and decision % 3 = 0 and (trial, decision, entity_id) not in (select (trial, decision, entity_id) from share_rows)""",
)
def _(t):
    held = cand_rows(t).where("held").select("trial", "decision", "entity_id")
    state = F.when(F.col("decision") % 3 == 0, "HOLD_ONLY").otherwise("NORMAL").alias("halt_state")
    verdicts = held.select("decision").distinct().select("decision", state)
    return ex.frozen_exits(held, targets(t), verdicts)


@query(
    "fill_window_observed", "order_id:i observed:b",
    """select order_id, a.n_bars - a.i >= 5 as observed from book_orders o asof join idx_bars a on a.entity_id = o.entity_id and a.session <= o.decided""",
)
def _(t):
    return ex.fill_window_observed(book_orders(t), t.bars, delay=1, max_bars=5)


@query(
    "lot_match_fifo", "buy_id:s sell_id:s opened:d closed:d units:f4 gain:f0",
    "select buy_id, sell_id, opened, closed, units, units * unit_net - units * unit_cost as gain from fifo",
)
def _(t):
    return ex.lot_match_fifo(t.fills, splits(t))


@query(
    "gain_term", "account:i entity_id:s term:s n:i units:f4",
    """select account, entity_id, case when closed - opened > 365 then 'LONG_TERM' else 'SHORT_TERM' end as term, count(*) as n, sum(units) as units
       from fifo group by 1, 2, 3""",
)
def _(t):
    m = ex.lot_match_fifo(t.fills, splits(t))
    return m.groupBy("account", "entity_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query(
    "realized_summary", "account:i short_term:f0 long_term:f0 total:f0",
    """select account, coalesce(sum(g) filter (not lt), 0) as short_term, coalesce(sum(g) filter (lt), 0) as long_term, sum(g) as total
       from (select account, units * unit_net - units * unit_cost as g, closed - opened > 365 as lt from fifo) group by rollup (account)""",
)
def _(t):
    return ex.realized_summary(ex.lot_match_fifo(t.fills, splits(t)))


@query(
    "positions_by_session", "account:i entity_id:s session:d quantity:f4",
    "select account, entity_id, session, quantity from position_rows",
)
def _(t):
    return positions(t)


@query(
    "entitled_dividends", "account:i entity_id:s ex_date:d entitled:f4 credit:f4",
    """select p.account, p.entity_id, a.effective_date as ex_date, quantity as entitled, quantity * amount as credit
       from position_rows p join actions a on a.entity_id = p.entity_id and kind = 'CASH_DIVIDEND' and p.session < a.effective_date
        and (p.next_session is null or p.next_session >= a.effective_date) where quantity <> 0""",
)
def _(t):
    d = t.actions.where("kind = 'CASH_DIVIDEND'").select("entity_id", F.col("effective_date").alias("ex_date"), F.col("effective_date").alias("pay_date"), "amount")
    return ex.entitled_dividends(positions(t), d)


@query(
    "nav_by_session", "account:i session:d cash:f0 nav:f0 invested:f4 n_held:i",
    """select account, session, cash, nav, case when nav > 0 then (nav - cash) / nav else 0 end as invested, coalesce(n_held, 0) as n_held from nav_rows""",
)
def _(t):
    return nav(t)


@query(
    "oversell_overspend", "fill_id:s account:i issue:s held_after:i n:i",
    """select fill_id, account, issue, min(held_after) as held_after, count(*) as n from (
         select *, case when side = 'SELL' and held_after < 0 then 'OVERSELL' when side = 'BUY' and cash_after < 0 then 'OVERSPEND' end as issue from (
           select *, sum(case when side = 'BUY' then qty else -qty end) over (partition by account, entity_id order by session, fill_id rows unbounded preceding) as held_after,
             50000000 + sum(cast(case when side = 'BUY' then -(price * qty + fee) else price * qty - fee end as decimal(38, 6)))
               over (partition by account order by session, fill_id rows unbounded preceding) as cash_after from fills))
       where issue is not null group by 1, 2, 3""",
)
def _(t):
    out = ex.oversell_overspend(t.fills, 5.0e7)
    return out.groupBy("fill_id", "account", "issue").agg(F.min("held_after").alias("held_after"), F.count(F.lit(1)).alias("n"))


@query(
    "book_state_asof", "account:i session:d high_water:f0 session_start:f0",
    """select account, session, max(nav) over (w rows unbounded preceding) as high_water, coalesce(lag(nav) over w, nav) as session_start
       from nav_rows window w as (partition by account order by session)""",
)
def _(t):
    return ex.book_state_asof(nav(t))


@query(
    "passive_arm", "entity_id:s session:d quantity:f4 nav:f0",
    """with e as (select entity_id, min(b.session) as entry, arg_min(open, b.session) * (1 + 7.0 / 10000) as p from bars b join sessions s using (session)
         where idx > 1 group by 1),
       q as (select *, floor(1e7 / p) as shares from e)
       select entity_id, session, shares * f as quantity, 1e7 - shares * p + shares * f * close + shares * d as nav from (
         select q.*, s.session, b.close, coalesce((select product(ratio) from actions a where a.entity_id = q.entity_id and kind = 'SPLIT'
             and effective_date > entry and effective_date <= s.session), 1) as f,
           coalesce((select sum(amount) from actions a where a.entity_id = q.entity_id and kind = 'CASH_DIVIDEND'
             and effective_date > entry and effective_date <= s.session), 0) as d
         from q join sessions s on s.session >= entry asof join bars b on b.entity_id = q.entity_id and b.session <= s.session)""",
)
def _(t):
    return ex.passive_arm(t.bars, t.actions, t.sessions, 1.0e7, delay=1)
