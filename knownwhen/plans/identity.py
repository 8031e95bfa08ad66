"""Identity and universe queries."""

from pyspark.sql import functions as F

from knownwhen.operators import identity as ident
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS

SQL_VIEWS["symbol_regs"] = """
select concat(c_mktsegment, c_custkey % 20) as symbol, c_custkey as entity_id, cast(min(o_orderdate) as date) as effective_from,
  min(o_orderdate) + interval 3 day as known_from
from customer join orders on o_custkey = c_custkey group by c_mktsegment, c_custkey"""
SQL_VIEWS["symbol_ranges"] = """
select r.*, (select min(effective_from) - 1 from symbol_regs n where n.symbol = r.symbol and n.effective_from > r.effective_from) as effective_to,
  (select min(known_from) from symbol_regs n where n.symbol = r.symbol and n.effective_from > r.effective_from) as close_known_from
from symbol_regs r"""
SQL_VIEWS["entity_ranges"] = """
select o_custkey as entity_id, concat(c_mktsegment, '-', substr(o_orderpriority, 1, 1)) as symbol, cast(min(o_orderdate) as date) as effective_from,
  case when o_orderpriority = '1-URGENT' then cast(min(o_orderdate) as date) + 300 end as effective_to,
  min(o_orderdate) + interval 2 day as known_from,
  case when o_orderpriority = '1-URGENT' then min(o_orderdate) + interval 310 day end as close_known_from, min(o_orderkey) as id
from orders join customer on c_custkey = o_custkey group by o_custkey, c_mktsegment, o_orderpriority"""
SQL_VIEWS["closed_ranges"] = """
select concat(c_mktsegment, c_custkey % 200) as symbol, c_custkey as entity_id, cast(min(o_orderdate) as date) as effective_from,
  case when c_custkey % 3 = 0 then cast(min(o_orderdate) as date) + cast(c_custkey % 400 as int) end as effective_to
from customer join orders on o_custkey = c_custkey group by c_mktsegment, c_custkey"""
SQL_VIEWS["id_actions"] = """
select o_orderkey as id, cast(o_custkey as varchar) as entity_id, case when o_orderpriority = '1-URGENT' then 'SYMBOL_CHANGE'
    when o_orderpriority = '2-HIGH' and o_orderkey % 7 = 0 then 'DELISTING' when o_orderpriority = '2-HIGH' and o_orderkey % 7 = 1 then 'MERGER'
    when o_orderpriority = '3-MEDIUM' then 'SPINOFF' else 'SPLIT' end as kind,
  cast(o_orderdate as date) as effective_date, o_orderdate + interval 1 day as available_at,
  concat('S', o_custkey, '-', year(o_orderdate) - 1) as old_symbol, concat('S', o_custkey, '-', year(o_orderdate)) as new_symbol,
  concat('C', o_orderkey) as child from orders"""
SQL_VIEWS["universe"] = """
select o_orderpriority as universe_id, cast(date_trunc('quarter', o_orderdate) as timestamp) as effective_at,
  cast(date_trunc('quarter', o_orderdate) as timestamp) + interval 5 day as available_at, min(o_orderkey) as id,
  list(distinct concat('N', c_nationkey)) as members, quarter(min(o_orderdate)) % 2 = 0 as survivorship_free
from orders join customer on c_custkey = o_custkey group by 1, 2"""
SQL_VIEWS["order_months"] = """
select distinct cast(date_trunc('month', o_orderdate) as timestamp) + interval 18 hour as decision_at from orders"""


def regs(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = j.groupBy("c_mktsegment", "c_custkey").agg(F.min("o_orderdate").alias("d"))
    return out.select(
        F.concat("c_mktsegment", F.col("c_custkey") % 20).alias("symbol"),
        F.col("c_custkey").alias("entity_id"),
        F.col("d").cast("date").alias("effective_from"),
        (F.col("d") + F.expr("interval 3 days")).alias("known_from"),
    )


def entity_ranges(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = j.groupBy("o_custkey", "c_mktsegment", "o_orderpriority").agg(F.min("o_orderdate").alias("d"), F.min("o_orderkey").alias("id"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return out.select(
        F.col("o_custkey").alias("entity_id"),
        F.concat("c_mktsegment", F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("symbol"),
        F.col("d").cast("date").alias("effective_from"),
        F.when(urgent, F.date_add(F.col("d").cast("date"), 300)).alias("effective_to"),
        (F.col("d") + F.expr("interval 2 days")).alias("known_from"),
        F.when(urgent, F.col("d") + F.expr("interval 310 days")).alias("close_known_from"),
        "id",
    )


def id_actions(t):
    k, n = F.col("o_orderpriority"), F.col("o_orderkey")
    kind = (
        F.when(k == "1-URGENT", "SYMBOL_CHANGE")
        .when((k == "2-HIGH") & (n % 7 == 0), "DELISTING")
        .when((k == "2-HIGH") & (n % 7 == 1), "MERGER")
        .when(k == "3-MEDIUM", "SPINOFF")
        .otherwise("SPLIT")
    )
    y = F.year("o_orderdate")
    return t.orders.select(
        n.alias("id"),
        F.col("o_custkey").cast("string").alias("entity_id"),
        kind.alias("kind"),
        F.col("o_orderdate").cast("date").alias("effective_date"),
        (F.col("o_orderdate") + F.expr("interval 1 day")).alias("available_at"),
        F.concat(F.lit("S"), "o_custkey", F.lit("-"), y - 1).alias("old_symbol"),
        F.concat(F.lit("S"), "o_custkey", F.lit("-"), y).alias("new_symbol"),
        F.concat(F.lit("C"), n).alias("child"),
    )


def universe(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    q = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    return j.groupBy(F.col("o_orderpriority").alias("universe_id"), q.alias("effective_at")).agg(
        F.min("o_orderkey").alias("id"),
        F.collect_set(F.concat(F.lit("N"), "c_nationkey")).alias("members"),
        (F.quarter(F.min("o_orderdate")) % 2 == 0).alias("survivorship_free"),
    ).withColumn("available_at", F.col("effective_at") + F.expr("interval 5 days"))


def order_months(t):
    m = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return t.orders.select((m + F.expr("interval 18 hours")).alias("decision_at")).distinct()


@query(
    "resolve_symbol",
    "order_id:i entity_id:i",
    """select order_id, case when count(distinct r.entity_id) = 1 then min(r.entity_id) end as entity_id from (
         select o_orderkey as order_id, concat(c_mktsegment, c_custkey % 20) as symbol, cast(o_orderdate as date) as on_date,
           o_orderdate + to_days(cast(o_orderkey % 10 as int)) as known_at from orders join customer on c_custkey = o_custkey) q
       left join symbol_ranges r on r.symbol = q.symbol and effective_from <= on_date and known_from <= known_at
         and (effective_to is null or effective_to >= on_date or close_known_from > known_at) group by 1""",
)
def _(t):
    q = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"),
        F.concat("c_mktsegment", F.col("c_custkey") % 20).alias("symbol"),
        F.col("o_orderdate").cast("date").alias("on_date"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))).alias("known_at"),
    )
    return ident.resolve_symbol(q, ident.close_open_ranges(regs(t)), "order_id")


@query(
    "symbols_for_entity",
    "entity_id:i symbols:s",
    """select entity_id, string_agg(distinct symbol, ',' order by symbol) as symbols from entity_ranges
       where known_from <= timestamp '1999-06-30' group by 1""",
)
def _(t):
    out = ident.symbols_for_entity(entity_ranges(t), F.lit("1999-06-30").cast("timestamp_ntz"))
    return out.withColumn("symbols", F.array_join("symbols", ","))


@query(
    "symbol_on",
    "order_id:i symbol:s",
    """select order_id, symbol from (select o_orderkey as order_id, r.symbol, row_number() over (partition by o_orderkey
         order by effective_from desc, id desc) as rn
         from orders left join entity_ranges r on r.entity_id = o_custkey and effective_from <= cast(o_orderdate as date)
          and known_from <= o_orderdate + interval 5 day and (effective_to is null or effective_to >= cast(o_orderdate as date)
          or close_known_from > o_orderdate + interval 5 day)) where rn = 1""",
)
def _(t):
    q = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").cast("date").alias("on_date"),
        (F.col("o_orderdate") + F.expr("interval 5 days")).alias("known_at"),
    )
    return ident.symbol_on(q, entity_ranges(t), "order_id")


@query(
    "build_ranges",
    "entity_id:s symbol:s effective_from:d effective_to:d known_from:t close_known_from:t",
    """with a as (select *, available_at + interval 15 minute as known_at from id_actions),
       c as (select * from a where kind = 'SYMBOL_CHANGE'),
       opens as (select entity_id, new_symbol as symbol, effective_date as effective_from, known_at as known_from from c
         union all select child, child, effective_date, known_at from a where kind = 'SPINOFF'),
       ends as (select entity_id, null as sym, case when kind = 'DELISTING' then effective_date else effective_date - 1 end as t, known_at as k
           from a where kind in ('DELISTING', 'MERGER')
         union all select entity_id, old_symbol, effective_date - 1, known_at from c),
       r as (select distinct o.*, (select min(struct_pack(t := t, k := k)) from ends e where e.entity_id = o.entity_id
           and (sym is null or sym = o.symbol) and t >= o.effective_from) as e from opens o),
       old as (select entity_id, old_symbol as symbol, min(struct_pack(d := effective_date, k := known_at)) as c from c group by 1, 2)
       select entity_id, symbol, effective_from, e.t as effective_to, known_from, e.k as close_known_from from r
       union all select entity_id, symbol, date '1800-01-01', c.d - 1, c.k, c.k from old o
       where not exists (select 1 from c x where x.entity_id = o.entity_id and x.new_symbol = o.symbol and x.effective_date < o.c.d)""",
)
def _(t):
    return ident.build_ranges(id_actions(t), F.lit(15))


@query(
    "range_conflicts",
    "symbol:s entity_a:i entity_b:i",
    """select distinct a.symbol, least(a.entity_id, b.entity_id) as entity_a, greatest(a.entity_id, b.entity_id) as entity_b
       from closed_ranges a join closed_ranges b on a.symbol = b.symbol and a.entity_id <> b.entity_id
        and a.effective_from <= b.effective_from and coalesce(a.effective_to, date '9999-12-31') >= b.effective_from
        and not (a.effective_to is null and a.effective_from < b.effective_from)""",
)
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    r = j.groupBy("c_mktsegment", "c_custkey").agg(F.min("o_orderdate").cast("date").alias("effective_from"))
    r = r.select(
        F.concat("c_mktsegment", F.col("c_custkey") % 200).alias("symbol"),
        F.col("c_custkey").alias("entity_id"),
        "effective_from",
        F.when(F.col("c_custkey") % 3 == 0, F.date_add("effective_from", (F.col("c_custkey") % 400).cast("int"))).alias("effective_to"),
    )
    return ident.range_conflicts(r)


@query(
    "close_open_ranges",
    "symbol:s entity_id:i effective_from:d effective_to:d close_known_from:t",
    "select symbol, entity_id, effective_from, effective_to, close_known_from from symbol_ranges",
)
def _(t):
    return ident.close_open_ranges(regs(t))


_MEMBERS = """select decision_at, universe_id, effective_at, survivorship_free, unnest(members) as entity_id from (
  select *, row_number() over (partition by decision_at, universe_id order by effective_at desc, id desc) as rn
  from universe join order_months on available_at <= decision_at) where rn = 1"""


@query(
    "members_asof",
    "decision_at:t universe_id:s effective_at:t entity_id:s",
    f"select decision_at, universe_id, effective_at, entity_id from ({_MEMBERS})",
)
def _(t):
    return ident.members_asof(universe(t), order_months(t), F.lit(0))


@query(
    "survivorship_label",
    "decision_at:t universe_id:s label:s n:i",
    f"""select decision_at, universe_id, case when not survivorship_free then 'SURVIVORSHIP_BIASED' end as label, count(*) as n
        from ({_MEMBERS}) group by all""",
)
def _(t):
    out = ident.members_asof(universe(t), order_months(t), F.lit(0))
    return out.groupBy("decision_at", "universe_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "admitted_members",
    "decision_at:t universe_id:s entity_id:s",
    f"""select decision_at, universe_id, entity_id from ({_MEMBERS}) m where not exists (select 1 from nation
        where concat('N', n_nationkey) = m.entity_id and n_nationkey % 5 = 0 and n_nationkey % 10 <> 0)""",
)
def _(t):
    n = F.col("n_nationkey")
    cond = t.nation.where(n % 5 == 0).select(
        F.concat(F.lit("N"), n).alias("entity_id"), F.when(n % 10 == 0, True).when(n % 15 != 0, False).alias("admitted")
    )
    return ident.admitted_members(ident.members_asof(universe(t), order_months(t), F.lit(0)), cond)
