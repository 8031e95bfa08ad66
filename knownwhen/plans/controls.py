"""Compliance, risk, decision and ledger queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.operators import calendars as cal
from knownwhen.operators import controls as ct
from knownwhen.operators import features as ft
from knownwhen.operators import identity as ident
from knownwhen.operators import ledger as lg
from knownwhen.operators import pit
from knownwhen.operators.market import by_entity
from knownwhen.operators.pit import win_intervals, with_visibility
from knownwhen.operators.scan import interval_join
from knownwhen.plans.catalog import query
from knownwhen.plans.feature_tables import weekly
from knownwhen.plans.identity import order_months, regs
from knownwhen.plans.selection import cand_rows, clusters
from knownwhen.plans.store import delay
from knownwhen.plans.views import SQL_VIEWS

BLACKOUTS = (("1996-03-01", "1996-03-20"), ("1999-11-15", "1999-12-05"))

# ---- compliance ----


@query(
    "compliance_screen", "candidate:i violations:s",
    """with c as (select o_orderkey as candidate, o_custkey as k, o_orderdate as now, concat('ALT', o_custkey % 500) as alt,
           case when o_custkey % 17 <> 0 then c_mktsegment end as theme from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F'),
         r as (select c_name as item, case when c_custkey % 2 = 0 then 'NAME' else 'ETF' end as rule, timestamp '2100-01-01' as until from customer where c_acctbal < 0
           union all select concat('ALT', c_custkey % 500), 'COOLING', max(greatest(timestamp '1996-01-01' + to_days(cast(c_custkey % 900 as int)), timestamp '1996-02-01' + to_days(cast(c_custkey % 700 as int)) + interval 30 day))
             from customer where c_custkey % 13 = 0 group by 1),
         v as (select candidate, concat_ws(',', case when datediff('day', date '1999-01-01', now) > 700 then 'RESTRICTED_LIST_STALE' end,
           case when exists (select 1 from r join customer on c_name = item where c_custkey = k and rule = 'NAME') then 'RESTRICTED_NAME' end,
           case when exists (select 1 from r join customer on c_name = item where c_custkey = k and rule = 'ETF') then 'RESTRICTED_ETF' end,
           case when exists (select 1 from r where item = alt and rule = 'COOLING' and now < until) then 'RESTRICTED_COOLING' end,
           case when theme is null then 'UNKNOWN_LOOK_THROUGH' end, case when theme in ('AUTOMOBILE', 'MACHINERY') then 'RESTRICTED_THEME' end,
           case when now between date '1996-03-01' and date '1996-03-20' or now between date '1999-11-15' and date '1999-12-05' then 'BLACKOUT' end) as violations from c)
       select * from v where violations <> ''""",
)
def _(t):
    k = F.col("o_custkey")
    c = t.orders.join(t.customer, k == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") != "F").alias("is_new_risk"), F.col("o_orderdate").alias("now"),
        F.array("c_name", F.concat(F.lit("ALT"), k % 500)).alias("identifiers"),
        F.when(k % 17 != 0, F.array("c_mktsegment")).alias("theme_exposures"),
    )
    n = F.col("c_custkey")
    names = t.customer.where("c_acctbal < 0").select(
        F.col("c_name").alias("item"), F.when(n % 2 == 0, "NAME").otherwise("ETF").alias("rule"), F.lit(None).cast("timestamp_ntz").alias("until")
    )

    def on(base, mod, plus=0):
        return F.date_add(F.lit(base).cast("date"), (n % mod).cast("int") + plus).cast("timestamp_ntz")

    cool = t.customer.where(n % 13 == 0).select(
        F.concat(F.lit("ALT"), n % 500).alias("item"), F.lit("COOLING").alias("rule"), F.greatest(on("1996-01-01", 900), on("1996-02-01", 700, 30)).alias("until")
    )
    out = ct.compliance_screen(
        c, names.unionByName(cool), themes=["AUTOMOBILE", "MACHINERY"], blackouts=BLACKOUTS, list_as_of="1999-01-01", max_age_days=700
    )
    return out.where(F.size("violations") > 0).withColumn("violations", F.array_join("violations", ","))


SQL_VIEWS["fund_lines"] = """
select p_brand as fund, p_partkey as line, concat(' ', p_name, ' ') as symbol, p_partkey as entity_id, p_retailprice / sum(p_retailprice) over (partition by p_brand) as weight from part"""
SQL_VIEWS["line_themes"] = """
select fund, line, concat('T', length(p_name) % 4) as theme from fund_lines join part on p_partkey = line
union select fund, line, concat('T-', p_type) from fund_lines join part on p_partkey = line"""


def fund_lines(t):
    w = Window.partitionBy("p_brand")
    return t.part.select(
        F.col("p_brand").alias("fund"), F.col("p_partkey").alias("line"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("symbol"),
        F.col("p_partkey").alias("entity_id"), (F.col("p_retailprice") / F.sum("p_retailprice").over(w)).alias("weight"),
    )


def line_themes(t):
    names = t.part.select(F.col("p_name").alias("symbol"), F.concat(F.lit("T"), F.length("p_name") % 4).alias("theme")).distinct()
    ents = t.part.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("T-"), "p_type").alias("theme"))
    return ct.theme_match(fund_lines(t), names, ents)


def brand_no(c):
    return F.replace(F.col(c), F.lit("Brand#"), F.lit("")).cast("int")


@query(
    "look_through", "fund:s n_lines:i theme_weight:f8 admissible:b theme_exposures:s",
    """with a as (select fund, line, min(weight) as w from fund_lines join line_themes using (fund, line) where theme in ('T1', 'T-LARGE') group by 1, 2),
         f as (select fund, count(*) as n_lines, date '2024-02-01' - cast(replace(fund, 'Brand#', '') as int) * 3 as as_of from fund_lines group by 1),
         s as (select f.*, coalesce((select sum(w) from a where a.fund = f.fund), 0) as w,
           (select string_agg(distinct theme, ',' order by theme) from line_themes l where l.fund = f.fund and theme in ('T1', 'T-LARGE')) as th, date '2024-03-01' - as_of <= 80 as known from f)
       select fund, n_lines, case when known then w end as theme_weight, case when known then w <= 0.35 end as admissible,
         case when known then case when w <= 0.35 then '' else th end end as theme_exposures from s""",
)
def _(t):
    funds = t.part.select(F.col("p_brand").alias("fund")).distinct().withColumn(
        "as_of", F.date_sub(F.lit("2024-02-01").cast("date"), brand_no("fund") * 3)
    )
    out = ct.look_through(
        fund_lines(t), line_themes(t), funds, restricted=["T1", "T-LARGE"], decision=F.lit("2024-03-01").cast("date"), max_age_days=80, threshold=0.35
    )
    return out.withColumn("theme_exposures", F.array_join("theme_exposures", ","))


@query("theme_match", "fund:s line:i theme:s", "select fund, line, theme from line_themes")
def _(t):
    return line_themes(t)


SQL_VIEWS["fund_snapshots"] = """
select o_orderpriority as fund, cast(date_trunc('month', o_orderdate) as date) as as_of, min(o_orderkey) as id, cast(date_trunc('month', o_orderdate) as timestamp) + interval 10 day as available_at
from orders group by 1, 2, 4"""


@query(
    "holdings_asof", "decision_at:t fund:s as_of:d n_lines:i n_resolved:i",
    """with w as (select decision_at, fund, max(as_of) as as_of from fund_snapshots join order_months on available_at <= decision_at group by 1, 2),
         l as (select w.*, concat(c_mktsegment, o_custkey % 20) as symbol from w join orders on o_orderpriority = fund and date_trunc('month', o_orderdate) = as_of join customer on c_custkey = o_custkey),
         s as (select decision_at, as_of, symbol, count(distinct entity_id) = 1 as ok from (select distinct decision_at, as_of, symbol from l) x left join symbol_ranges r using (symbol)
           where r.effective_from <= as_of and known_from <= decision_at and (effective_to is null or effective_to >= as_of or close_known_from > decision_at) group by 1, 2, 3)
       select l.decision_at, l.fund, l.as_of, count(*) as n_lines, count(*) filter (ok) as n_resolved from l left join s using (decision_at, as_of, symbol) group by 1, 2, 3""",
)
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    lines = j.select(F.col("o_orderpriority").alias("fund"), month.alias("as_of"), F.concat("c_mktsegment", F.col("o_custkey") % 20).alias("symbol"))
    snaps = lines.groupBy("fund", "as_of").agg(F.count(F.lit(1)).alias("id")).withColumn(
        "available_at", F.col("as_of").cast("timestamp_ntz") + F.expr("interval 10 days")
    )
    s = with_visibility(snaps.withColumn("vintage_at", F.lit(None).cast("timestamp_ntz")), F.lit(0)).drop("vintage_at")
    wins = win_intervals(s, ["fund"], ["as_of", "id"], F.year("as_of"))
    at = interval_join(wins, order_months(t), [], "visible_at", "visible_to", "decision_at", unit="month").select("decision_at", "fund", "as_of")
    held = at.join(lines, ["fund", "as_of"])
    # A symbol is resolved once per (decision, date), not once per line.
    ask = held.select("symbol", F.col("as_of").alias("on_date"), F.col("decision_at").alias("known_at")).distinct()
    ask = ask.withColumn("k", F.concat_ws("|", "symbol", F.col("on_date").cast("string"), F.col("known_at").cast("string")))
    found = ident.resolve_symbol(ask, ident.close_open_ranges(regs(t)), "k")
    held = held.withColumn("k", F.concat_ws("|", "symbol", F.col("as_of").cast("string"), F.col("decision_at").cast("string")))
    return held.join(found, "k", "left").groupBy("decision_at", "fund", "as_of").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("entity_id").alias("n_resolved")
    )


@query(
    "theme_coverage", "fund:s status:s",
    """with r as (select distinct concat('T-', c_mktsegment) as theme from customer union select distinct concat('T-', p_type) from part),
         gap as (select count(*) as n from r where theme not in (select theme from line_themes))
       select fund, case when cast(replace(fund, 'Brand#', '') as int) % 3 <> 0 then 'EMPTY' when n > 0 then 'UNKNOWN' else 'EVALUATE' end as status
       from (select distinct p_brand as fund from part), gap""",
)
def _(t):
    funds = t.part.select(F.col("p_brand").alias("fund")).distinct()
    r = t.customer.select(F.concat(F.lit("T-"), "c_mktsegment").alias("theme")).union(t.part.select(F.concat(F.lit("T-"), "p_type"))).distinct()
    return ct.theme_coverage(funds, line_themes(t), r, funds.where(brand_no("fund") % 3 == 0))


# ---- risk ----

SQL_VIEWS["book_lines"] = """
select trial, decision, entity_id, (shares - 2) / 120.0 as weight, n % 7 / 20.0 as current_weight, case when n % 5 <> 0 then adv end as adv, px
from cand_rows where held"""
SQL_VIEWS["book_heads"] = """
select trial, decision, 1 - sum(greatest(weight, 0)) as cash_weight, case when decision % 5 = 0 then 'HOLD_ONLY' else 'NORMAL' end as halt_state from book_lines group by 1, 2"""
# A brand has the sector of its largest part; one sector is left unclassified.
SQL_VIEWS["line_sectors"] = """
select * from (select p_brand as entity_id, nullif(concat('sector_', arg_max(p_type, struct_pack(a := p_size, b := -p_partkey))), 'sector_ECONOMY') as sector from part group by 1)
where sector is not null"""
SQL_VIEWS["risk_rows"] = """
select trial, decision, unnest(list_filter([case when cast(weight as decimal(20, 12)) < 0 then 'NEGATIVE_WEIGHT' end, case when cast(weight as decimal(20, 12)) > 0.3 then 'SINGLE_LINE_WEIGHT' end], lambda x: x is not null)) as code, entity_id as subject from book_lines
union all select trial, decision, unnest(list_filter([case when n > 9 then 'MAX_OPEN_POSITIONS' end, case when g > 1.2 then 'GROSS_EXPOSURE' end, case when g > 1.1 then 'NET_EXPOSURE' end,
  case when cash_weight < 0.02 then 'MIN_CASH' end], lambda x: x is not null)), '*' from (select b.*, coalesce(n, 0) as n, coalesce(g, 0) as g from book_heads b left join
    (select trial, decision, count(*) as n, sum(cast(weight as decimal(20, 12))) as g from book_lines where weight > 0 group by 1, 2) using (trial, decision))
union all select trial, decision, case when cast(replace(entity_id, 'Brand#', '') as int) % 9 = 0 then 'NOT_ADMITTED' else 'UNCLASSIFIED_HOLDING' end, entity_id from book_lines where weight > 0
  and (cast(replace(entity_id, 'Brand#', '') as int) % 9 = 0 or entity_id not in (select entity_id from line_sectors))
union all select trial, decision, 'SECTOR_CONCENTRATION', sector from book_lines join line_sectors using (entity_id) where weight > 0 and cast(replace(entity_id, 'Brand#', '') as int) % 9 <> 0
  group by 1, 2, 4 having sum(cast(weight as decimal(20, 12))) > 0.6
union all select trial, decision, unnest(list_filter([case when sum(cast(weight as decimal(20, 12))) > 0.5 then 'CLUSTER_WEIGHT' end, case when count(*) > 2 then 'CLUSTER_MEMBERS' end], lambda x: x is not null)), cluster_id
  from book_lines join cand_clusters using (entity_id) where weight > 0 group by trial, decision, cluster_id"""
SQL_VIEWS["liquidity_rows"] = """
select trial, decision, unnest(list_filter([case when adv is null then 'LIQUIDITY_UNKNOWN' end, case when adv < 300000 then 'MIN_ADV' end,
  case when adv is not null and px < 5000 then 'MIN_PRICE' end], lambda x: x is not null)) as code, entity_id as subject from book_lines where weight > current_weight"""


def book_lines(t):
    c = cand_rows(t).where("held")
    # The number of lines behind a candidate row is even where it is held.
    n = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id")), "l_partkey").groupBy(
        (F.col("l_suppkey") % 5).alias("trial"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("decision"), "entity_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    x = c.join(n, ["trial", "decision", "entity_id"])
    return x.select(
        "trial", "decision", "entity_id", ((F.col("shares") - 2) / 120.0).alias("weight"), (F.col("n") % 7 / 20.0).alias("current_weight"),
        F.when(F.col("n") % 5 != 0, F.col("adv")).alias("adv"), "px",
    )


def book_heads(lines):
    g = lines.groupBy("trial", "decision").agg((1 - F.sum(F.greatest("weight", F.lit(0.0)))).alias("cash_weight"))
    return g.withColumn("halt_state", F.when(F.col("decision") % 5 == 0, "HOLD_ONLY").otherwise("NORMAL"))


def risk_rows(t, lines):
    ents = t.part.select(F.col("p_brand").alias("entity_id")).distinct()
    largest = F.max_by("p_type", F.struct("p_size", -F.col("p_partkey")))
    sectors = t.part.groupBy(F.col("p_brand").alias("entity_id")).agg(F.nullif(F.concat(F.lit("sector_"), largest), F.lit("sector_ECONOMY")).alias("sector")).where("sector is not null")
    return ct.risk_limits(
        lines, book_heads(lines), ents.where(brand_no("entity_id") % 9 != 0), sectors, clusters(t), max_line=0.3, max_positions=9, max_gross=1.2,
        max_net=1.1, min_cash=0.02, max_sector=0.6, max_cluster=0.5,
    )


@query("risk_limits", "trial:i decision:i code:s subject:s", "select trial, decision, code, subject from risk_rows")
def _(t):
    return risk_rows(t, book_lines(t))


@query("liquidity_limits", "trial:i decision:i code:s subject:s", "select trial, decision, code, subject from liquidity_rows")
def _(t):
    return ct.liquidity_limits(book_lines(t), 300000.0, 5000.0)


SQL_VIEWS["session_orders"] = """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as order_id, l_suppkey % 20 as account, cast(l_shipdate as date) as session, p_brand as entity_id,
  case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, l_quantity as qty, l_extendedprice / 1000 as price, case when l_linenumber <> 3 then l_extendedprice / 1000 * (1 - l_discount / 20) end as bid,
  case when l_linenumber <> 3 then l_extendedprice / 1000 * (1 + (l_tax - 0.01) / 20) end as ask, case when l_partkey % 7 <> 0 then 400.0 * (l_partkey % 50) end as adv, 4000.0 * (l_suppkey % 11) as nav
from lineitem join part on p_partkey = l_partkey"""
SQL_VIEWS["order_rows"] = """
select *, case when price > 0 then abs(qty) * case when side = 'SELL' and bid > 0 and ask >= bid then greatest(price, bid) else price end end as notional,
  coalesce(bid > 0 and ask >= bid, false) as vq, coalesce(adv > 0, false) as adv_ok, (bid + ask) / 2 as mid from session_orders"""


@query(
    "order_limits", "account:i session:d code:s n:i",
    """with r as (select account, session, unnest(list_filter([case when qty > 45 then 'QTY_CAP' end, case when notional > 3500 then 'NOTIONAL_CAP' end,
           case when not adv_ok and side = 'BUY' then 'ADV_UNKNOWN' end, case when adv_ok and notional > 0.2 * adv then 'ADV_PARTICIPATION' end,
           case when side = 'BUY' and adv_ok and vq and adv < 2000 then 'MIN_ADV' end, case when side = 'BUY' and adv_ok and vq and mid < 20 then 'MIN_PRICE' end,
           case when side = 'BUY' and bid is null then 'SPREAD_UNOBSERVED' end, case when side = 'BUY' and bid is not null and not vq then 'BAD_QUOTE' end,
           case when side = 'BUY' and vq and (ask - bid) / mid * 10000 > 60 then 'SPREAD' end], lambda x: x is not null)) as code from order_rows),
         h as (select l_suppkey % 20 as account, p_brand as entity_id, 30 as held from lineitem join part on p_partkey = l_partkey where l_quantity > 48 group by 1, 2),
         l as (select account, session, entity_id, sum(case when side = 'SELL' then abs(qty) else 0 end) as sold, max((side = 'BUY')::int) as buys, coalesce(max(held), 0) as held
           from order_rows left join h using (account, entity_id) group by 1, 2, 3),
         a as (select account, session, count(*) as n, sum(notional) as t, max(nav) as nav, max((side = 'BUY')::int) as buy from order_rows group by 1, 2),
         z as (select a.*, (select count(*) from l where l.account = a.account and l.session = a.session and buys = 1 and held <= 0) as fresh from a),
         u as (select * from r union all select account, session, 'SELL_EXCEEDS_HELD' from l where sold > held
           union all select account, session, unnest(list_filter([case when n > 3 then 'MAX_ORDERS_PER_SESSION' end, case when fresh > 1 then 'MAX_NEW_POSITIONS' end, case when not nav > 0 and buy = 1 then 'BAD_NAV' end,
             case when nav > 0 and t / nullif(nav, 0) > 0.25 then 'DAILY_TURNOVER' end], lambda x: x is not null)) from z)
       select account, session, code, count(*) as n from u group by 1, 2, 3""",
)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    li = t.lineitem.join(p, "l_partkey")
    px = F.col("l_extendedprice") / 1000
    quoted = F.col("l_linenumber") != 3
    orders = li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("order_id"),
        (F.col("l_suppkey") % 20).alias("account"), F.col("l_shipdate").cast("date").alias("session"), "entity_id",
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), px.alias("price"),
        F.when(quoted, px * (1 - F.col("l_discount") / 20)).alias("bid"), F.when(quoted, px * (1 + (F.col("l_tax") - 0.01) / 20)).alias("ask"),
        F.when(F.col("l_partkey") % 7 != 0, F.lit(400.0) * (F.col("l_partkey") % 50)).alias("adv"), (F.lit(4000.0) * (F.col("l_suppkey") % 11)).alias("nav"),
    )
    held = li.where("l_quantity > 48").select((F.col("l_suppkey") % 20).alias("account"), "entity_id").distinct().withColumn("held", F.lit(30))
    out = ct.order_limits(
        orders, held, max_qty=45, max_notional=3500.0, participation=0.2, max_spread_bps=60.0, min_adv=2000.0, min_price=20.0, max_orders=3, max_new=1, max_turnover=0.25
    )
    return out.groupBy("account", "session", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hard_cap_recheck", "order_id:i reason_codes:s",
    """with i as (select o_orderkey as k, o_totalprice / 2000 as qty, case when o_orderkey % 3 = 0 then 'MARKET' when o_orderkey % 31 = 1 then 'STOP' else 'LIMIT' end as ty, case when o_orderstatus = 'F' then 'SELL' when o_orderkey % 37 = 0 then 'SHORT' else 'BUY' end as side,
           case when o_orderkey % 5 <> 0 then o_totalprice / 5000 end as lim, o_totalprice / 5100 as bid, o_totalprice / 4900 as ask, cast(o_orderkey % 90 as int) - 5 as age from orders),
         p as (select *, case when ty = 'LIMIT' and side = 'SELL' then case when lim is not null then greatest(lim, bid) end when ty = 'LIMIT' then lim when side = 'BUY' then ask else bid end as px, round(qty) as q from i)
       select * from (select k as order_id, concat_ws(',', case when k % 41 = 0 then 'ACCOUNT_MISMATCH' end, case when k % 43 = 0 then 'LIVE_UNAVAILABLE' end, case when side = 'SHORT' then 'SIDE' end, case when ty = 'STOP' then 'ORDER_TYPE' end,
         case when k % 47 = 0 then 'TIF' end, case when k % 53 = 0 then 'EXTENDED_HOURS' end, case when qq <> floor(qq) then 'FRACTIONAL' end, case when qq > 200 then 'QTY_CAP' end,
         case when px is null or not px > 0 then 'BAD_LIMIT' end, case when age < 0 or age > 60 then 'STALE_QUOTE' end, case when px > 0 and qq * px > 15000 then 'NOTIONAL_CAP' end) as reason_codes
       from (select *, case when k % 29 = 0 then q + 0.5 else q end as qq from p)) where reason_codes <> ''""",
)
def _(t):
    k, tot = F.col("o_orderkey"), F.col("o_totalprice")
    qty = F.round(tot / 2000) + F.when(k % 29 == 0, 0.5).otherwise(0.0)
    now = F.lit("2024-01-01 15:00:00").cast("timestamp_ntz")
    i = t.orders.select(
        k.alias("order_id"), F.when(k % 41 == 0, "other").otherwise("main").alias("account_id"), F.when(k % 43 == 0, "LIVE_SMALL").otherwise("PAPER").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "SELL").when(k % 37 == 0, "SHORT").otherwise("BUY").alias("side"),
        F.when(k % 3 == 0, "MARKET").when(k % 31 == 1, "STOP").otherwise("LIMIT").alias("order_type"), F.when(k % 47 == 0, "GTC").otherwise("DAY").alias("tif"),
        (k % 53 == 0).alias("extended_hours"), qty.alias("qty"), F.when(k % 5 != 0, tot / 5000).alias("limit_price"), (tot / 5100).alias("bid"), (tot / 4900).alias("ask"),
        now.alias("now"), (now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 90 - 5).cast("decimal(18,6)"))).alias("quote_at"),
    )
    out = ct.hard_caps(i, account="main", sides=["BUY", "SELL"], types=["MARKET", "LIMIT"], tifs=["DAY"], max_qty=200, max_notional=15000.0, max_quote_age_s=60)
    return out.where(F.size("reason_codes") > 0).withColumn("reason_codes", F.array_join("reason_codes", ","))


# ---- halt state ----

SQL_VIEWS["arm_days"] = """
select user_id as arm, cast(ts as date) as session, cast(sum(cast(value as decimal(18, 2))) as double) as raw, count(*) as n,
  count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'signup') as signups, count(*) filter (event_type = 'view') as views from events group by 1, 2"""
SQL_VIEWS["fault_rows"] = """
select arm, session, concat_ws(',', case when nav is null then 'UNKNOWN_STATE' end, case when nav is not null and dd >= 0.5 then 'DRAWDOWN_HOLD_ONLY' end,
    case when nav is not null and dd >= 0.3 and dd < 0.5 then 'DRAWDOWN_HALT_NEW_RISK' end, case when nav is not null and loss >= 0.25 then 'DAILY_LOSS_HALT' end,
    case when stale > 0 then 'STALE_INPUT' end, case when recon then 'RECONCILIATION_UNRESOLVED' end, case when crit > 0 then 'SEVERE_INCIDENT' end, case when crit = 0 and high > 0 then 'SEVERE_INCIDENT' end) as faults,
  greatest(0, case when nav is null then 1 else 0 end, case when nav is not null and dd >= 0.5 then 2 else 0 end, case when nav is not null and dd >= 0.3 then 1 else 0 end, case when nav is not null and loss >= 0.25 then 1 else 0 end,
    case when stale > 0 then 1 else 0 end, case when recon then 2 else 0 end, case when crit > 0 then 2 else 0 end, case when crit = 0 and high > 0 then 1 else 0 end) as floor_rank, rearm_to
from (select *, (hw - nav) / hw as dd, (st - nav) / st as loss from (select *, max(1000 + raw) over w as hw, coalesce(lag(1000 + raw) over (partition by arm order by session), 1000 + raw) as st,
    case when n % 11 <> 0 then 1000 + raw end as nav, case when views = 0 then 1 else 0 end as stale, errors >= 2 as recon, case when signups >= 2 then 1 else 0 end as crit, case when signups = 1 and errors = 1 then 1 else 0 end as high,
    case when n % 4 = 1 then 0 when n % 4 = 3 then 1 end as rearm_to from arm_days window w as (partition by arm order by session rows unbounded preceding)))"""
SQL_VIEWS["halt_seq"] = "select *, row_number() over (partition by arm order by session) as k from fault_rows"
SQL_VIEWS["halt_chain"] = """
select arm, session, k, 0 as from_rank, case when rearm_to is not null then greatest(floor_rank, rearm_to, -1) else greatest(0, floor_rank) end as r from halt_seq where k = 1
union all select s.arm, s.session, s.k, h.r, case when s.rearm_to is not null then greatest(s.floor_rank, s.rearm_to, h.r - 1) else greatest(h.r, s.floor_rank) end
from halt_chain h join halt_seq s on s.arm = h.arm and s.k = h.k + 1"""


def arm_days(t):
    k = F.col("event_type")
    return t.events.groupBy(F.col("user_id").alias("arm"), F.col("ts").cast("date").alias("session")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("raw"), F.count(F.lit(1)).alias("n"), F.count_if(k == "error").alias("errors"),
        F.count_if(k == "signup").alias("signups"), F.count_if(k == "view").alias("views"),
    )


def fault_rows(t):
    w = Window.partitionBy("arm").orderBy("session")
    lvl = F.col("raw") + 1000
    x = arm_days(t).select(
        "arm", "session", F.when(F.col("n") % 11 != 0, lvl).alias("nav"), F.max(lvl).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("high_water"),
        F.coalesce(F.lag(lvl).over(w), lvl).alias("session_start"), F.when(F.col("views") == 0, 1).otherwise(0).alias("n_stale"),
        (F.col("errors") >= 2).alias("unreconciled"), F.when(F.col("signups") >= 2, 1).otherwise(0).alias("n_critical"),
        F.when((F.col("signups") == 1) & (F.col("errors") == 1), 1).otherwise(0).alias("n_high"),
        F.when(F.col("n") % 4 == 1, 0).when(F.col("n") % 4 == 3, 1).alias("rearm_to"),
        *[F.lit(False).alias(c) for c in ("broker_unknown", "order_uncertain", "disagree", "authorization_expired", "version_change")],
    )
    return ct.halt_faults(x, hold_drawdown=0.5, halt_drawdown=0.3, daily_loss=0.25)


@query("halt_faults", "arm:i session:d faults:s floor_rank:i", "select arm, session, faults, floor_rank from fault_rows")
def _(t):
    return fault_rows(t).withColumn("faults", F.array_join("faults", ","))


@query(
    "halt_state_scan", "arm:i session:d from_rank:i state:s",
    "select arm, session, from_rank, ['NORMAL', 'HALT_NEW_RISK', 'HOLD_ONLY'][r + 1] as state from halt_chain",
)
def _(t):
    return ct.halt_state_scan(fault_rows(t), ["arm"], "session")


@query(
    "break_occurrences", "arm:i code:s first_report:d length:i status:s",
    """with r as (select *, row_number() over (partition by arm order by session) as seq, count(*) over (partition by arm) as total from arm_days),
         b as (select r.arm, code, r.session, r.seq, total from r join (select distinct user_id as arm, cast(ts as date) as session, event_type as code from events) using (arm, session)),
         f as (select b.*, (select max(seq) from r where r.arm = b.arm and not exists (select 1 from b c where c.arm = b.arm and c.code = b.code and c.seq = r.seq)) as last_clear from b),
         u as (select arm, code, min(session) as first_report, count(*) as length from f where seq > coalesce(last_clear, 0) group by 1, 2),
         a as (select user_id as arm, event_type as code, max(cast(ts as date)) as acked from events where event_id % 5 = 0 group by 1, 2)
       select u.*, case when acked >= first_report then 'ACKNOWLEDGED' when first_report < date '2024-01-29' then 'UNRESOLVED' else 'FRESH' end as status from u left join a using (arm, code)""",
)
def _(t):
    e = t.events.select(F.col("user_id").alias("arm"), F.col("ts").cast("date").alias("session"), F.col("event_type").alias("code"), "event_id")
    acks = e.where(F.col("event_id") % 5 == 0).select("arm", "code", F.col("session").alias("acked"))
    return ct.break_occurrences(e.select("arm", "session").distinct(), e.select("arm", "session", "code"), acks, F.lit("2024-01-29").cast("date"))


@query(
    "decision_gate", "trial:i decision:i increased:i uncovered:i not_admitted:i n_violations:i new_risk_allowed:b blocked_by:s",
    """with e as (select trial, decision, entity_id, not restricted as ok from cand_rows),
         up as (select trial, decision, count(*) as increased, count(*) filter (not exists (select 1 from e where e.trial = l.trial and e.decision = l.decision and e.entity_id = l.entity_id)) as uncovered
           from book_lines l where weight > current_weight group by 1, 2),
         v as (select trial, decision, count(*) as n from (select trial, decision from risk_rows union all select trial, decision from liquidity_rows) group by 1, 2),
         c as (select trial, decision, count(*) filter (not ok) as n from e group by 1, 2),
         x as (select h.*, coalesce(increased, 0) as increased, coalesce(uncovered, 0) as uncovered, coalesce(c.n, 0) as not_admitted, coalesce(v.n, 0) as n_violations
           from book_heads h left join up using (trial, decision) left join c using (trial, decision) left join v using (trial, decision))
       select *, halt_state = 'NORMAL' and n_violations = 0 and not_admitted = 0 and uncovered = 0 as new_risk_allowed, concat_ws(',', case when halt_state <> 'NORMAL' then 'HALT' end, case when n_violations > 0 then 'LIMIT' end,
         case when not_admitted > 0 then 'COMPLIANCE' end, case when uncovered > 0 then 'MISSING_COMPLIANCE' end) as blocked_by from x""",
)
def _(t):
    lines = book_lines(t)
    e = cand_rows(t).select("trial", "decision", "entity_id", (~F.col("restricted")).alias("admitted"))
    bad = risk_rows(t, lines).unionByName(ct.liquidity_limits(lines, 300000.0, 5000.0))
    return ct.decision_gate(lines, book_heads(lines), e, bad).withColumn("blocked_by", F.array_join("blocked_by", ","))


@query(
    "stale_market", "decision_session:d faults:s",
    """with b as (select * from bars_sparse),
         x as (select decision_session, (select max(session) from b where b.session <= decision_session) as a, (select max(session) from b where b.session <= decision_session and entity_id = 'Brand#1') as c from weekly)
       select * from (select decision_session, concat_ws(',', case when a is null then 'NO_MARKET_DATA' when a < decision_session then 'ALL_FEEDS_BEHIND' end, case when a is not null and coalesce(c <> a, true) then 'CASH_LEG_BEHIND' end) as faults from x) where faults <> ''""",
)
def _(t):
    b = t.bars_sparse.withColumn("next_session", F.lead("session").over(by_entity()))
    last = ft.last_bars(b, weekly(t))
    a = ft.anchor_sessions(last, weekly(t))
    cash = last.where(F.col("entity_id") == "Brand#1").select("decision_session", F.col("session").alias("_c"))
    a = a.join(cash, "decision_session", "left").withColumn("cash_at_anchor", F.col("_c") == F.col("anchor_session"))
    return ct.stale_market(a).withColumn("faults", F.array_join("faults", ","))


# ---- records ----


@query(
    "seal_records", "o_orderkey:i seal:s duplicate_key:b",
    """select o_orderkey, concat('sha256:', sha256(concat('{"o_custkey":', o_custkey, ',"o_orderkey":', o_orderkey, ',"o_orderpriority":"', o_orderpriority, '","o_orderstatus":"', o_orderstatus, '"}'))) as seal,
         count(*) over (partition by o_custkey, cast(o_orderdate as date)) > 1 as duplicate_key from orders""",
)
def _(t):
    rows = t.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return ct.seal_records(rows, ["o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority"], ["o_custkey", "day"])


@query(
    "missing_records", "kind:s arm:i session:d",
    """with s as (select l_suppkey % 20 as arm, cast(l_shipdate as date) as session, count(*) filter (l_linenumber <= 3) as early, sum(cast(l_quantity as bigint)) as q from lineitem group by 1, 2),
         i as (select day, (select max(idx) from xnys where session <= day) as here from cal_days where day between date '1994-12-20' and date '2002-06-30'),
         o as (select s.*, x.session as owed from s join i on i.day = s.session join xnys x on x.idx = i.here + 10),
         w as (select max(session) as session from xnys where session between (select min(session) from s) and date '2001-09-30' group by date_trunc('week', session))
       select 'MISSING_DECISION_RECORD' as kind, arm, session from w cross join (select distinct arm from s) where (arm, session) not in (select (arm, session) from s)
       union all select 'MISSING_FILL_RECORD', arm, session from o where owed <= date '2001-09-30' and early = 0
       union all select distinct 'UNFILLED_REMAINDER', l_suppkey % 20, cast(l_shipdate as date) from lineitem where l_linenumber = 7 and l_returnflag = 'R'
       union all select 'NEGATIVE_CASH', arm, session from s where q % 97 = 0""",
)
def _(t):
    arm, day = (F.col("l_suppkey") % 20).alias("arm"), F.col("l_shipdate").cast("date").alias("session")
    s = t.lineitem.groupBy(arm, day).agg(F.count_if(F.col("l_linenumber") <= 3).alias("early"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    d = F.col("l_shipdate").cast("date")
    span = t.lineitem.agg(F.date_sub(F.min(d), 30).alias("first"), F.date_add(F.max(d), 60).alias("last"))
    sealed = cal.nth_session_after(s, "session", 10, cal.day_table(span), "owed_by")
    week = cal.weekly_decisions(cal.session_calendar(t.lineitem.agg(F.min(d).alias("first"), F.lit("2001-09-30").cast("date").alias("last"))))
    un = t.lineitem.where("l_linenumber = 7 and l_returnflag = 'R'").select(arm, day, F.lit("LIQUIDITY").alias("reason"))
    cash = s.select("arm", "session", F.when(F.col("q") % 97 == 0, -1).otherwise(1).alias("cash"))
    return ct.missing_records(sealed, week, s.select("arm").distinct(), s.where("early > 0"), un, cash, F.lit("2001-09-30").cast("date"))


SQL_VIEWS["assessed"] = """
select conv_id as candidate, count(*) filter (turn % 2 = 0) as n_for, count(*) filter (turn % 2 = 1) as n_against, max(turn) % 5 = 4 as abstain, sum(length(text)) as chars from conversations group by 1"""


def assessments(t):
    doc = F.col("conv_id") * (F.col("turn") + 1)
    own = F.array(F.concat(F.lit("F"), F.col("conv_id") % 3))
    g = t.conversations.groupBy(F.col("conv_id").alias("candidate")).agg(
        F.collect_set(F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 4 != 1), doc)).alias("evidence_for"),
        F.collect_set(F.when((F.col("turn") % 2 == 1) & (F.col("conv_id") % 4 != 2), doc)).alias("evidence_against"),
        (F.max("turn") % 5 == 4).alias("abstain"), F.sum(F.length("text")).alias("chars"),
    )
    c = F.col("candidate")
    return g.withColumn("abstain_reason", F.when(c % 2 == 0, F.lit("thin"))).withColumn("thesis", F.when(F.col("chars") % 7 == 0, F.lit("  ")).otherwise("holds")).withColumn(
        "factors", F.array(F.concat(F.lit("F"), c % 3), F.lit("G"))
    ).withColumn("factors_touched", F.when(c % 6 != 5, F.array(F.lit("G"), F.concat(F.lit("F"), c % 3))).otherwise(F.array(F.lit("G"))))


@query(
    "overlay_arms", "arm:s candidate:i label:s",
    """with a as (select conv_id as candidate, count(*) filter (turn % 2 = 0 and conv_id % 4 <> 1) > 0 as f, count(*) filter (turn % 2 = 1 and conv_id % 4 <> 2) > 0 as g, max(turn) % 5 = 4 as abstain from conversations group by 1)
       select 'C1' as arm, doc_id as candidate, 'HISTORICAL_REPLAY_CONTAMINATED' as label from labels left join a on candidate = doc_id where not coalesce(not abstain and g and not f, false)
       union all select 'D1', candidate, 'HISTORICAL_REPLAY_CONTAMINATED' from a where not abstain and f and not g""",
)
def _(t):
    base = t.labels.select(F.col("doc_id").alias("candidate"))
    return ct.overlay_arms(base, assessments(t), replay=True)


@query(
    "assessment_checks", "candidate:i rejection:s n_unresolved:i",
    """with e as (select distinct conv_id as candidate, conv_id * (turn + 1) as source from conversations where (turn % 2 = 0 and conv_id % 4 <> 1) or (turn % 2 = 1 and conv_id % 4 <> 2)),
         u as (select candidate, count(*) filter (source not in (select doc_id from documents)) as n from e group by 1),
         a as (select candidate, abstain, chars, coalesce(n, 0) as n from assessed left join u using (candidate))
       select candidate, case when abstain and candidate % 2 <> 0 then 'MISSING_ABSTAIN_REASON' when abstain then null when chars % 7 = 0 then 'EMPTY_THESIS' when n > 0 then 'CITATION_UNRESOLVED'
         when candidate % 6 = 5 then 'FACTOR_MISMATCH' end as rejection, n as n_unresolved from a""",
)
def _(t):
    a = assessments(t)
    cited = a.select("candidate", F.explode(F.array_union("evidence_for", "evidence_against")).alias("source"))
    packets = cited.join(t.documents.select(F.col("doc_id").alias("source")), "source", "left_semi")
    return ct.assessment_checks(a, packets)


@query(
    "evidence_packets", "decision_at:t entity_id:s n:i packet_hash:s",
    """select decision_at, entity_id, count(*) as n, concat('sha256:', sha256(string_agg(concat_ws('|', source_id, strftime(effective_at, '%Y-%m-%d'), id, source_locator, strftime(available_at, '%Y-%m-%d %H:%M:%S.%f'), sha256(cast(cast(value as decimal(18, 2)) as varchar)), cast(cast(value as decimal(18, 2)) as varchar)), ';' order by source_id, effective_at, id))) as packet_hash
       from collapsed_obs where flag <> 'ARTIFACT_MISSING' group by 1, 2""",
)
def _(t):
    text = F.col("value").cast("decimal(18,2)").cast("string")
    facts = pit.asof_latest(t.obs, t.decisions, delay(), by=["entity_id"]).withColumns({"raw_content_hash": F.sha2(text, 256), "value": text})
    return ct.evidence_packets(facts, ["decision_at", "decision_month", "entity_id"]).withColumn("n", F.size("facts"))


EXTRA = {"TOKEN": r'token\s*=\s*"[0-9a-f]+"', "CARD_NUMBER": r"\b\d{16}\b"}


@query(
    "redaction_scan", "origin:s id:i findings:s",
    r"""select * from (select origin, id, concat_ws(',', case when origin <> 'documents' and regexp_matches(text, '\$\s?\d{1,3}(,\d{3})+(\.\d+)?') then 'CURRENCY_TOTAL' end, case when regexp_matches(text, '(?i)sk-[a-z0-9]') then 'API_KEY' end,
         case when regexp_matches(text, '(?i)bearer\s+[a-z0-9._-]+') then 'BEARER' end, case when regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') then 'ACCESS_KEY_ID' end,
         case when regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') then 'PRIVATE_KEY' end, case when regexp_matches(text, 'token\s*=\s*"[0-9a-f]+"') then 'TOKEN' end,
         case when regexp_matches(text, '\b\d{16}\b') then 'CARD_NUMBER' end) as findings
       from (select 'documents' as origin, doc_id as id, text from documents union all select 'conversations', conv_id * 1000 + turn, text from conversations
         union all select 'pages', page_id, html from pages)) where findings <> ''""",
)
def _(t):
    texts = (
        t.documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        .union(t.conversations.select(F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text"))
        .union(t.pages.select(F.lit("pages"), "page_id", "html"))
    )
    # Documents stand for excerpts of sources.
    out = ct.redaction_scan(texts, extra=EXTRA, excerpt=F.col("origin") == "documents").where(F.size("findings") > 0)
    return out.withColumn("findings", F.array_join("findings", ","))


@query(
    "call_spend", "day:d calls:i day_cost:f4 month_cost:f4",
    """select *, sum(day_cost) over (partition by date_trunc('month', day)) as month_cost from (select cast(ts as date) as day, count(*) as calls, sum(cast(value as decimal(18, 4))) as day_cost from events group by 1)""",
)
def _(t):
    return ct.call_spend(t.events.select(F.col("ts").alias("at"), F.col("value").cast("decimal(18,4)").alias("cost")))


# ---- ledger ----

def ledger_events(t):
    """Ledger rows with a hash each, for the seals."""
    n = F.col("event_id")
    return t.events.select(n.alias("seq"), F.col("ts").alias("at"), F.sha2(F.concat(F.lit("h"), n), 256).alias("hash"))


CHAIN = """with recursive e as (select event_id as seq, concat_ws('|', event_type, user_id) as body, event_id // 200 as blk from events),
         c as (select seq, body, blk, cast(null as varchar) as prev_hash, sha256(concat_ws('|', seq, '', body)) as h from e where seq % 200 = 0
           union all select e.seq, e.body, e.blk, c.h, sha256(concat_ws('|', e.seq, c.h, e.body)) from c join e on e.seq = c.seq + 1 and e.blk = c.blk),
         d as (select seq, body, case when seq % 991 = 5 then 'x' else prev_hash end as prev_hash, case when seq % 997 = 7 then 'y' else h end as hash from c where seq % 983 <> 11),
         v as (select d.*, p.hash as before, p.seq is not null as has from d left join d p on p.seq = d.seq - 1)"""
BREAKS = """select seq, concat_ws(',', case when not has and seq <> (select min(seq) from d) then 'SEQUENCE_GAP' end, case when has and prev_hash is distinct from before then 'PREV_HASH_MISMATCH' end,
         case when hash <> sha256(concat_ws('|', seq, coalesce(prev_hash, ''), body)) then 'HASH_MISMATCH' end) as breaks from v"""


@query("hash_chain_verify", "seq:i breaks:s", f"{CHAIN} select * from ({BREAKS}) where breaks <> ''")
def _(t):
    return lg.hash_chain_verify(chained(t), F.col("body")).where(F.size("breaks") > 0).withColumn("breaks", F.array_join("breaks", ","))


SEALED_BEFORE = "2024-01-29"


@query(
    "chain_report", "events:i broken:i first_break:i tail:i",
    f"""{CHAIN} select count(*) as events, count(*) filter (breaks <> '') as broken, min(case when breaks <> '' then seq end) as first_break,
         count(*) filter (seq > (select max(event_id) from events where ts < timestamp '{SEALED_BEFORE}')) as tail from ({BREAKS})""",
)
def _(t):
    sealed = t.events.where(F.col("ts") < F.lit(SEALED_BEFORE).cast("timestamp_ntz")).agg(F.max("event_id")).scalar()
    return lg.chain_report(lg.hash_chain_verify(chained(t), F.col("body")), sealed)


def chained(t):
    """Events linked in blocks of 200, with a few links, hashes and rows damaged on purpose."""
    n = F.col("event_id")
    e = t.events.select(n.alias("seq"), F.col("ts").alias("at"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("body"))
    block = e.groupBy(F.floor(F.col("seq") / 200).alias("b")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "body"))).alias("rows"))
    start = F.struct(F.lit(None).cast("string").alias("h"), F.array().cast("array<struct<seq:bigint,at:timestamp_ntz,body:string,prev_hash:string,hash:string>>").alias("out"))

    def link(acc, r):
        h = F.sha2(F.concat_ws("|", r["seq"].cast("string"), F.coalesce(acc["h"], F.lit("")), r["body"]), 256)
        row = F.struct(r["seq"].alias("seq"), r["at"].alias("at"), r["body"].alias("body"), acc["h"].alias("prev_hash"), h.alias("hash"))
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(row)).alias("out"))

    out = block.select(F.explode(F.aggregate("rows", start, link)["out"]).alias("r")).select("r.*").where("seq % 983 <> 11")
    return out.withColumn("prev_hash", F.when(F.col("seq") % 991 == 5, "x").otherwise(F.col("prev_hash"))).withColumn(
        "hash", F.when(F.col("seq") % 997 == 7, "y").otherwise(F.col("hash"))
    )


SQL_VIEWS["seal_rows"] = """
select cast(ts as date) as day, sha256(string_agg(sha256(concat('h', event_id)), '' order by event_id)) as root, min(event_id) as first_seq, max(event_id) as last_seq, count(*) as events from events group by 1"""


@query(
    "daily_seals", "day:d root:s first_seq:i last_seq:i events:i", "select day, root, first_seq, last_seq, events from seal_rows"
)
def _(t):
    return lg.daily_seals(ledger_events(t))


def stored_seals(t):
    """Seals as stored: one day in five is missing, another has lost its last event."""
    d = F.dayofmonth(F.col("at"))
    s = lg.daily_seals(ledger_events(t).where(d % 5 != 0))
    return s.withColumn("root", F.when(F.dayofmonth("day") % 7 == 1, F.reverse("root")).otherwise(F.col("root")))


@query(
    "seal_mismatch", "day:d events:i status:s",
    """select day, events, case when day(day) % 5 = 0 then 'UNSEALED' else 'MISMATCH' end as status from seal_rows where day(day) % 5 = 0 or day(day) % 7 = 1""",
)
def _(t):
    return lg.seal_mismatch(lg.daily_seals(ledger_events(t)), stored_seals(t))


@query(
    "unsealed_dates", "day:d events:i", "select day, events from seal_rows where day(day) % 5 = 0 and day <= date '2024-01-26'"
)
def _(t):
    return lg.unsealed_dates(lg.daily_seals(ledger_events(t)), stored_seals(t), F.lit("2024-01-26").cast("date"))


def tree_views(name, rows):
    """SQL views of the hash tree over ``rows`` (day, seq, hash), one for each level."""
    SQL_VIEWS[f"{name}0"] = f"""
select day, seq as block, seq as first_seq, seq as last_seq, 1 as events, 1 as n, sha256(concat_ws('|', '0', seq, hash)) as node from ({rows})"""
    for k in range(1, lg.DEPTH + 1):
        up = "0" if k == lg.DEPTH else f"block // {lg.FANOUT}"
        SQL_VIEWS[f"{name}{k}"] = f"""
select day, {up} as block, min(first_seq) as first_seq, max(last_seq) as last_seq, sum(events) as events, count(*) as n,
  case when count(*) = 1 then min(node) else sha256(concat('1', string_agg(concat(block, ':', node), ',' order by block))) end as node
from {name}{k - 1} group by 1, 2"""


tree_views("tree", "select cast(ts as date) as day, event_id as seq, sha256(concat('h', event_id)) as hash from events")
tree_views("kept_tree", "select cast(ts as date) as day, event_id as seq, case when event_id % 997 = 7 then 'y' else sha256(concat('h', event_id)) end as hash from events where event_id // 64 % 89 <> 5")


@query("merkle_seals", "day:d root:s first_seq:i last_seq:i events:i", f"select day, node as root, first_seq, last_seq, events from tree{lg.DEPTH}")
def _(t):
    return lg.merkle_seals(ledger_events(t))


@query(
    "merkle_damage", "day:d block:i first_seq:i last_seq:i status:s",
    """select coalesce(a.day, b.day) as day, coalesce(a.block, b.block) as block, least(a.first_seq, b.first_seq) as first_seq, greatest(a.last_seq, b.last_seq) as last_seq,
         case when a.node is null then 'MISSING' when b.node is null then 'ADDED' else 'CHANGED' end as status
       from kept_tree1 a full join (select * from tree1 where block % 97 <> 3) b on a.day = b.day and a.block = b.block where a.node is distinct from b.node""",
)
def _(t):
    """Against the stored tree: some hashes were altered later, some blocks lost, some never stored."""
    n, e = F.col("seq"), ledger_events(t)
    now = e.where(F.floor(n / 64) % 89 != 5).withColumn("hash", F.when(n % 997 == 7, "y").otherwise(F.col("hash")))
    return lg.damaged_blocks(lg.merkle_nodes(now), lg.merkle_nodes(e).where("block % 97 != 3"))


@query(
    "merkle_proofs", "day:d seq:i widths:s nodes:s valid:b",
    f"""with a as (select day, unnest([min(seq), max(seq)]) as seq from (select cast(ts as date) as day, event_id as seq from events) group by 1),
         p as (select distinct day, seq from a)
       select p.day, p.seq, concat_ws(',', {", ".join(f"t{k}.n" for k in range(1, lg.DEPTH + 1))}) as widths, concat_ws(',', {", ".join(f"t{k}.node" for k in range(1, lg.DEPTH + 1))}) as nodes, day(p.day) % 7 <> 1 as valid
       from p {" ".join(f"join tree{k} t{k} on t{k}.day = p.day and t{k}.block = {'0' if k == lg.DEPTH else f'p.seq // {lg.FANOUT**k}'}" for k in range(1, lg.DEPTH + 1))}""",
)
def _(t):
    """The first and last event of each date, proved against stored roots of which one in seven was altered."""
    e = ledger_events(t)
    nodes = lg.merkle_nodes(e)
    roots = nodes.where(F.col("level") == lg.DEPTH).select("day", "first_seq", "last_seq", F.when(F.dayofmonth("day") % 7 == 1, F.reverse("node")).otherwise(F.col("node")).alias("root"))
    asked = roots.select("day", F.explode(F.array("first_seq", "last_seq")).alias("seq"))
    out = lg.verify_proofs(lg.inclusion_proofs(nodes, asked), e, roots)
    widths = F.transform("path", lambda p: F.size(p["children"]).cast("string"))
    return out.select("day", "seq", F.array_join(widths, ",").alias("widths"), F.array_join(F.transform("path", lambda p: lg._node(p["children"])), ",").alias("nodes"), "valid")


_STATES = ("SUBMITTING", "ACKNOWLEDGED", "PARTIALLY_FILLED", "FILLED", "UNKNOWN", "CLOSED")
SQL_VIEWS["order_log"] = f"""
select user_id as order_id, event_id as seq, case when event_id % 19 = 0 then concat('d', event_id // 38) else concat('e', event_id) end as event_id,
  {list(_STATES)!r}[event_id * 7 % 6 + 1] as state, case when user_id % 2 = 0 then 'BUY' else 'SELL' end as side,
  case when event_id % 3 = 0 then 'reconciliation: broker' else 'broker' end as reason, cast(round(value) as bigint) as cum_qty from events"""


def order_log(t):
    n = F.col("event_id")
    states = F.array(*[F.lit(s) for s in _STATES])
    return t.events.select(
        F.col("user_id").alias("order_id"), n.alias("seq"), F.when(n % 19 == 0, F.concat(F.lit("d"), F.floor(n / 38))).otherwise(F.concat(F.lit("e"), n)).alias("event_id"),
        F.element_at(states, (n * 7 % 6 + 1).cast("int")).alias("state"), F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.when(n % 3 == 0, "reconciliation: broker").otherwise("broker").alias("reason"), F.round("value").cast("bigint").alias("cum_qty"),
    )


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in lg.TRANSITIONS.items() for b in bs)


@query(
    "order_transition_audit", "seq:i from_state:s issues:s",
    f"""with d as (select *, seq > min(seq) over (partition by event_id) as dup from order_log),
         x as (select *, last_value(case when not dup then state end ignore nulls) over w as from_state, max(case when not dup then cum_qty end) over w as mx from d
           window w as (partition by order_id order by seq rows between unbounded preceding and 1 preceding)),
         y as (select *, (from_state, state) in ({_LEGAL}) as ok from x)
       select * from (select seq, from_state, concat_ws(',', case when dup then 'DUPLICATE_EVENT' end, case when not dup and from_state is not null and not ok then 'ILLEGAL_TRANSITION' end,
         case when not dup and ok and from_state = 'UNKNOWN' and not starts_with(reason, 'reconciliation:') then 'RECONCILE_ONLY' end,
         case when not dup and ok and from_state = 'FILLED' and state = 'CLOSED' and side <> 'SELL' then 'EXIT_ONLY' end,
         case when not dup and state in ('PARTIALLY_FILLED', 'FILLED') and mx > 0 and cum_qty <= mx then 'STALE_FILL' end) as issues from y) where issues <> ''""",
)
def _(t):
    out = lg.order_transition_audit(order_log(t), F.floor(F.col("seq") / 4096)).where(F.size("issues") > 0)
    return out.withColumn("issues", F.array_join("issues", ","))


@query(
    "job_health", "job:s last_status:s last_finished:t runs:i missed:i failed:i",
    """with r as (select event_type as job, event_id, ts, case when event_id % 7 = 0 then 'FAILED' when event_id % 7 = 3 then 'MISSED' else 'OK' end as status from events)
       select job, arg_max(status, event_id) as last_status, max(ts) + interval 5 minute as last_finished, count(*) as runs, count(*) filter (status = 'MISSED') as missed, count(*) filter (status = 'FAILED') as failed from r group by 1""",
)
def _(t):
    n = F.col("event_id")
    return lg.job_health(
        t.events.select(
            F.col("event_type").alias("job"), n.alias("run_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("interval 5 minutes")).alias("finished_at"),
            F.when(n % 7 == 0, "FAILED").when(n % 7 == 3, "MISSED").otherwise("OK").alias("status"),
        )
    )


@query(
    "source_coverage", "prefix:s rows:i earliest:t latest:t last_ingested:t entities:i bytes:i",
    """select event_type as prefix, count(*) as rows, min(ts) as earliest, max(ts) as latest, max(ts) + interval 1 hour as last_ingested, count(distinct user_id) as entities, sum(length(props)) as bytes from events group by 1""",
)
def _(t):
    return lg.source_coverage(
        t.events.select(
            F.concat("event_type", F.lit("."), F.col("user_id") % 3).alias("source_id"), F.col("ts").alias("available_at"),
            (F.col("ts") + F.expr("interval 1 hour")).alias("ingested_at"), F.col("user_id").alias("entity_id"), F.length("props").alias("bytes"),
        )
    )


@query(
    "days_behind", "entity_id:s days_behind:i",
    """select cast(user_id as varchar) as entity_id, greatest(datediff('day', max(ts), timestamp '2024-01-28'), 0) as days_behind from events group by 1""",
)
def _(t):
    last = pit.latest_available(t.obs, ["entity_id"])
    return last.withColumn("days_behind", lg.days_behind(F.col("latest_available_at"), F.lit("2024-01-28").cast("date")))
