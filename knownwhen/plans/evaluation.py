"""Walk-forward, robustness, pooling and registry queries."""

from pyspark.sql import functions as F

from knownwhen.operators import evaluation as ev
from knownwhen.plans.catalog import query
from knownwhen.plans.measures import _boot_view
from knownwhen.plans.selection import cand_rows
from knownwhen.plans.views import SQL_VIEWS

SQL_VIEWS["ranges"] = """
select p_brand as brand, cast(min(l_shipdate) as date) + cast(min(p_partkey) % 28 as int) as start, cast(max(l_shipdate) as date) as end_date
from lineitem join part on p_partkey = l_partkey group by 1"""
SQL_VIEWS["design_starts"] = """
select brand, end_date, 0 as split_no, start as ds from ranges
union all select brand, end_date, split_no + 1, cast(ds + interval 5 month as date) from design_starts where ds < end_date"""
SQL_VIEWS["wf_splits"] = """
select * from (select brand, split_no, ds as design_start, de as design_end, de + 27 as eval_start,
    least(cast(de + 27 + interval 5 month as date) - 1, end_date) as eval_end,
    lag(least(cast(de + 27 + interval 5 month as date) - 1, end_date) >= end_date, 1, false) over (partition by brand order by split_no) as over
  from (select *, cast(ds + interval 12 month as date) as de from design_starts) where de + 27 <= end_date) where not over"""


def ranges(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    g = t.lineitem.join(p, "l_partkey").groupBy("brand").agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("end"), F.min("l_partkey").alias("k")
    )
    return g.select("brand", F.date_add("a", (F.col("k") % 28).cast("int")).alias("start"), "end")


def wf_splits(t):
    return ev.walk_forward_splits(ranges(t), window_years=1, step_months=5, purge=21, embargo=5)


@query(
    "walk_forward_splits", "brand:s split_no:i design_start:d design_end:d eval_start:d eval_end:d",
    "select brand, split_no, design_start, design_end, eval_start, eval_end from wf_splits",
)
def _(t):
    return wf_splits(t)


@query(
    "split_plan", "brand:s kind:s eval_start:d eval_end:d overlaps_holdout:b",
    """with s as (select brand, 'WALK_FORWARD' as kind, eval_start, eval_end from wf_splits
         union all select brand, 'DESIGN', start, start + 365 from ranges union all select brand, 'RECENT', end_date - 90, end_date from ranges)
       select *, eval_start <= date '2000-12-31' and eval_end >= date '2000-07-01' as overlaps_holdout from s""",
)
def _(t):
    r = ranges(t)
    seg = r.select("brand", F.lit("DESIGN").alias("kind"), F.col("start").alias("eval_start"), F.date_add("start", 365).alias("eval_end")).unionByName(
        r.select("brand", F.lit("RECENT").alias("kind"), F.date_sub("end", 90).alias("eval_start"), F.col("end").alias("eval_end"))
    )
    return ev.split_plan(wf_splits(t), seg, F.lit("2000-07-01").cast("date"), F.lit("2000-12-31").cast("date"))


def assigned(t):
    s = t.bars_sparse.select(F.col("entity_id").alias("brand"), "session")
    return ev.assign_split(s, wf_splits(t).select("brand", "split_no", "eval_start", "eval_end"), ["brand"])


@query(
    "assign_split", "brand:s session:d split_no:i",
    "select brand, session, split_no from bars_sparse join wf_splits on brand = entity_id and session between eval_start and eval_end",
)
def _(t):
    return assigned(t)


@query(
    "independent_blocks", "brand:s split_no:i blocks:i",
    """select brand, split_no, count(*) // 21 as blocks from bars_sparse join wf_splits on brand = entity_id and session between eval_start and eval_end group by 1, 2""",
)
def _(t):
    return ev.independent_blocks(assigned(t), ["brand", "split_no"])


ORDER = ["kind", "segment", "priority"]
SQL_VIEWS["grid_rows"] = """
select n_name as strategy, k.v as kind, s.v as segment, p.v as priority, row_number() over (partition by n_name order by k.v, s.v, p.v) as point
from nation, (select distinct p_type as v from part) k, (select distinct c_mktsegment as v from customer) s, (select distinct o_orderpriority as v from orders) p"""


def grid(t):
    dims = (
        t.part.select(F.lit("kind").alias("dimension"), F.col("p_type").alias("value"))
        .union(t.customer.select(F.lit("segment"), "c_mktsegment"))
        .union(t.orders.select(F.lit("priority"), "o_orderpriority"))
    ).distinct()
    names = t.nation.agg(F.collect_set("n_name").alias("names"))
    arrays = ev.sensitivity_grid(dims, ORDER)
    return arrays.withColumn("strategy", F.explode(names.scalar()))


@query(
    "sensitivity_grid", "strategy:s point:i kind:s segment:s priority:s registered:b",
    "select *, kind = 'LARGE' and segment = 'MACHINERY' and priority = '2-HIGH' as registered from grid_rows",
)
def _(t):
    return ev.grid_points(grid(t), ORDER, {"kind": "LARGE", "segment": "MACHINERY", "priority": "2-HIGH"}, ["strategy"])


@query(
    "grid_neighbours", "strategy:s point:i dimension:s value:s neighbour:i",
    """select a.strategy, a.point, case when a.kind <> b.kind then 'kind' when a.segment <> b.segment then 'segment' else 'priority' end as dimension,
         case when a.kind <> b.kind then b.kind when a.segment <> b.segment then b.segment else b.priority end as value, b.point as neighbour
       from grid_rows a join grid_rows b on a.strategy = b.strategy
        and (a.kind <> b.kind)::int + (a.segment <> b.segment)::int + (a.priority <> b.priority)::int = 1""",
)
def _(t):
    return ev.grid_neighbours(grid(t), ORDER, ["strategy"])


@query(
    "cost_delay_tiers", "experiment:i tier:s kind:s multiplier:f2 delay_bars:i missing_rate:f4 bars_promotion:b",
    """select c_custkey as experiment, tier, kind, multiplier, delay_bars, missing_rate, bars_promotion from customer, (values
         ('cost/base', 'COST', 1.0, 1, 0.0, false), ('cost/adverse', 'COST', 1.0, 2, 0.0, false), ('cost/stress', 'COST', 1.0, 0, 0.0, true),
         ('cost/base_x1.5', 'COST', 1.5, 1, 0.0, false), ('cost/base_x3', 'COST', 3.0, 1, 0.0, false), ('delay/0', 'DELAY', 1.0, 0, 0.0, true),
         ('delay/2', 'DELAY', 1.0, 2, 0.0, false), ('missing/0.01', 'MISSING_DATA', 1.0, 1, 0.01, true), ('missing/0.05', 'MISSING_DATA', 1.0, 1, 0.05, true))
         v(tier, kind, multiplier, delay_bars, missing_rate, bars_promotion)""",
)
def _(t):
    s = t.customer.select(F.col("c_custkey").alias("experiment"))
    return ev.cost_delay_tiers(s, {"base": 1, "adverse": 2, "stress": 0}, [1, 1.5, 3], [0, 1, 2], [0, 0.01, 0.05])


SQL_VIEWS["metric_rows"] = """
select o_custkey as experiment, (k % 2001 - 1000) / 1000.0 as estimate, case when k % 23 <> 0 then (k % 2001 - 1000) / 1000.0 - 0.3 end as lower, (k % 2001 - 1000) / 1000.0 + 0.1 + (k % 3) as upper,
  -(k % 50) / 100.0 as strategy_drawdown, -(k % 41) / 100.0 as benchmark_drawdown, case when k % 29 <> 0 then (k % 2001 - 1000) / 1000.0 - (k % 7) / 10.0 end as adverse,
  (k % 2001 - 1000) / 1000.0 - (k % 5) / 10.0 as delayed, (k % 2001 - 1000) / 1000.0 - (k % 11) / 10.0 as without_best, n * 10 as decisions,
  case when o_custkey % 4 <> 0 then (k % 9 - 4) / 10.0 end as secondary, k, n
from (select o_custkey, sum(cast(round(o_totalprice * 100) as bigint)) as k, count(*) as n from orders group by 1)"""
SQL_VIEWS["metric_agreement"] = """
select o_custkey as experiment, count(*) as grid_size, count(*) filter (sign(o_orderkey * 7 % 2001 - 1000) = sign(estimate)) as agreeing
from orders join metric_rows on experiment = o_custkey group by 1"""


def metric_rows(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("experiment")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n")
    )
    k = F.col("k")
    est = (k % 2001 - 1000) / 1000.0
    return g.select(
        "experiment", est.alias("estimate"), F.when(k % 23 != 0, est - 0.3).alias("lower"), (est + 0.1 + k % 3).alias("upper"),
        (-(k % 50) / 100.0).alias("strategy_drawdown"), (-(k % 41) / 100.0).alias("benchmark_drawdown"), F.when(k % 29 != 0, est - k % 7 / 10.0).alias("adverse"),
        (est - k % 5 / 10.0).alias("delayed"), (est - k % 11 / 10.0).alias("without_best"), (F.col("n") * 10).alias("decisions"),
        F.when(F.col("experiment") % 4 != 0, (k % 9 - 4) / 10.0).alias("secondary"), "k", "n",
    )


@query(
    "falsifiers", "experiment:i failed:s agreement:f6 passes:b decisive_rejection:b",
    """with x as (select m.*, agreeing / cast(grid_size as double) as agreement, estimate < 0.1 or not ((lower > 0 and upper > 0) or (lower < 0 and upper < 0)) as f1
         from metric_rows m join metric_agreement using (experiment)),
       y as (select *, concat_ws(',', case when f1 then 'F1' end, case when abs(strategy_drawdown) > abs(benchmark_drawdown) * 0.75 then 'F2' end,
         case when sign(adverse) <> sign(estimate) or sign(delayed) <> sign(estimate) then 'F3' end, case when sign(without_best) <> sign(estimate) then 'F4' end,
         case when agreement < 0.4 then 'F5' end, case when decisions < 60 then 'MINIMUM_DECISIONS' end, case when lower is null or adverse is null then 'UNEVALUATED' end) as failed from x)
       select experiment, failed, agreement, failed = '' as passes, case when secondary is not null then f1 and not secondary > 0 end as decisive_rejection from y""",
)
def _(t):
    m = metric_rows(t)
    est = t.orders.select(F.col("o_custkey").alias("experiment"), (F.col("o_orderkey") * 7 % 2001 - 1000).alias("grid_estimate"))
    out = ev.falsifiers(m.join(ev.sign_agreement(est, m, "experiment"), "experiment"), threshold=0.1, drawdown_ratio=0.75, min_agreement=0.4, min_decisions=60)
    return out.withColumn("failed", F.array_join("failed", ","))


@query(
    "missing_data_injection", "trial:i decision:i entity_id:s mom:f6 injected:b",
    """select trial, decision, entity_id, case when n % 100 >= 5 then mom end as mom, n % 100 < 5 as injected
       from (select *, row_number() over (partition by trial order by decision, entity_id) as n from (select trial, decision, entity_id, mom from cand_rows))""",
)
def _(t):
    return ev.missing_data_injection(cand_rows(t), 0.05, ["mom", "trend", "vol"])


SQL_VIEWS["pool_rows"] = """
select entity_id, concat('Y', year(session)) as split_id, session, (volume % 41 - 20) / 1000.0 as strategy, (volume % 37 - 18) / 1000.0 as benchmark,
  case when year(session) = 1995 then 'DESIGN' else 'WALK_FORWARD' end as kind from bars_sparse"""
SQL_VIEWS["pool_all"] = """
select * from pool_rows union all select entity_id, concat('Y', year(session) - 1), session, strategy, benchmark, kind from pool_rows where dayofyear(session) = 1"""
SQL_VIEWS["pool_planned"] = """
select distinct p_brand as entity_id, concat('Y', y) as split_id from part, range(1996, 2003) r(y)"""
SQL_VIEWS["pool_levels"] = """
select *, product(1 + strategy) over (partition by entity_id, split_id order by session rows unbounded preceding) as level,
  product(1 + benchmark) over (partition by entity_id, split_id order by session rows unbounded preceding) as plevel from pool_rows where kind = 'WALK_FORWARD'"""
SQL_VIEWS["pool_growth"] = """
select entity_id, split_id, arg_max(level, session) / arg_min(level, session) as g, arg_max(plevel, session) / arg_min(plevel, session) as pg,
  arg_min(level, session) as first, arg_min(plevel, session) as pfirst from pool_levels group by 1, 2"""
SQL_VIEWS["pool_chained"] = """
select l.entity_id, l.split_id, l.session, level / first * coalesce((select product(g) from pool_growth p where p.entity_id = l.entity_id and p.split_id < l.split_id), 1) as chained,
  plevel / pfirst * coalesce((select product(pg) from pool_growth p where p.entity_id = l.entity_id and p.split_id < l.split_id), 1) as pchained
from pool_levels l join pool_growth g on g.entity_id = l.entity_id and g.split_id = l.split_id"""
SQL_VIEWS["pool_gaps"] = """
select entity_id, count(*) as gapped from (select entity_id, split_id from pool_rows join bars_sparse using (entity_id, session) where volume % 997 = 3 group by 1, 2) group by 1"""


def pool_rows(t):
    v = F.col("volume")
    y = F.year("session")
    return t.bars_sparse.select(
        "entity_id", F.concat(F.lit("Y"), y).alias("split_id"), "session", ((v % 41 - 20) / 1000.0).alias("strategy"),
        ((v % 37 - 18) / 1000.0).alias("benchmark"), F.when(y == 1995, "DESIGN").otherwise("WALK_FORWARD").alias("kind"), "volume",
    )


def pool_levels(t):
    w = ev.Window.partitionBy("entity_id", "split_id").orderBy("session").rowsBetween(ev.Window.unboundedPreceding, 0)
    x = pool_rows(t).where("kind = 'WALK_FORWARD'")
    return x.withColumn("level", F.product(1 + F.col("strategy")).over(w)).withColumn("plevel", F.product(1 + F.col("benchmark")).over(w))


def pool_gaps(t):
    g = pool_rows(t).where("volume % 997 = 3").select("entity_id", "split_id").distinct()
    return g.groupBy("entity_id").agg(F.count(F.lit(1)).alias("gapped"))


@query(
    "pool_splits", "entity_id:s split_id:s n:i n_twice:i errors:s",
    """with d as (select entity_id, session from pool_all group by 1, 2 having count(distinct split_id) > 1),
       s as (select p.entity_id, p.split_id, count(*) as n, count(d.session) as n_twice, max(kind) as kind from pool_all p left join d using (entity_id, session) group by 1, 2)
       select entity_id, split_id, n, n_twice, concat_ws(',', case when n is null then 'MISSING' end, case when kind <> 'WALK_FORWARD' then 'WRONG_KIND' end,
         case when not planned or planned is null then 'NOT_PLANNED' end, case when n_twice > 0 then 'SCORED_TWICE' end) as errors
       from s full join (select *, true as planned from pool_planned) using (entity_id, split_id)""",
)
def _(t):
    x = pool_rows(t)
    prior = x.where(F.dayofyear("session") == 1).withColumn("split_id", F.concat(F.lit("Y"), F.year("session") - 1))
    planned = t.part.select(F.col("p_brand").alias("entity_id")).distinct()
    planned = planned.withColumn("split_id", F.explode(F.array(*[F.lit(f"Y{y}") for y in range(1996, 2003)])))
    out = ev.pool_splits(x.unionByName(prior), planned, ["entity_id"])
    return out.withColumn("errors", F.array_join("errors", ","))


@query(
    "chain_link_levels", "entity_id:s split_id:s session:d log_level:f7",
    "select entity_id, split_id, session, ln(chained) as log_level from pool_chained",
)
def _(t):
    return ev.chain_link_levels(pool_levels(t), ["entity_id"]).withColumn("log_level", F.ln("chained"))


@query("link_returns", "entity_id:s linked:f7", "select entity_id, product(g) - 1 as linked from pool_growth group by 1")
def _(t):
    g = pool_levels(t).groupBy("entity_id", "split_id").agg((F.max_by("level", "session") / F.min_by("level", "session") - 1).alias("r"))
    return ev.link_returns(g, "r", ["entity_id"])


SQL_VIEWS["pool_pairs"] = "select entity_id, session, strategy, benchmark from pool_rows where kind = 'WALK_FORWARD'"
SQL_VIEWS["pool_numbered"] = "select *, row_number() over (partition by entity_id order by session) - 1 as i from pool_pairs"
SQL_VIEWS["boot_pool"] = _boot_view("pool_pairs", "session", 21).replace("range(200)", "range(100)")
_SH = "case when stddev_samp({x}) > 0 then avg({x}) / stddev_samp({x}) * sqrt(252) else 0 end"


@query(
    "pooled_primary", "entity_id:s n:i estimate:f6 lower:f6 upper:f6 withheld:s passes:b",
    f"""with b as (select entity_id, r, {_SH.format(x='strategy')} - {_SH.format(x='benchmark')} as d from boot_pool b join pool_numbered p using (entity_id) where p.i = b.idx group by 1, 2),
       c as (select entity_id, quantile_cont(d, 0.05) as lower, quantile_cont(d, 0.95) as upper from b group by 1),
       e as (select entity_id, count(*) as n, {_SH.format(x='strategy')} - {_SH.format(x='benchmark')} as estimate from pool_pairs group by 1),
       w as (select *, concat_ws(',', case when gapped > 0 then 'GAPPED_SPLIT' end, case when estimate >= 0.3 and (lower > 0 or upper < 0) then 'UNADJUSTED_PASS' end) as withheld
         from e join c using (entity_id) left join pool_gaps using (entity_id))
       select *, case when withheld = '' then false end as passes from w""",
)
def _(t):
    pairs = pool_rows(t).where("kind = 'WALK_FORWARD'").select("entity_id", "session", "strategy", "benchmark")
    out = ev.pooled_primary(pairs, pool_gaps(t), threshold=0.3, resamples=2000)
    return out.withColumn("withheld", F.array_join("withheld", ","))


_SEC = """select entity_id, split_id, max(g) - 1 as candidate, case when max(pg) < 2.5 then max(pg) - 1 end as comparator,
  count(*) filter (volume % 997 = 3) as gaps from pool_growth join pool_rows using (entity_id, split_id) join (select entity_id, session, volume from bars_sparse) using (entity_id, session) group by 1, 2"""


@query(
    "pooled_secondary", "entity_id:s lacking:i gapped:i excess:f7 beats:b",
    f"""select entity_id, count(*) filter (comparator is null) as lacking, count(*) filter (gaps > 0) as gapped,
         case when count(*) filter (comparator is null or gaps > 0) = 0 then product(1 + candidate) - product(1 + comparator) end as excess,
         case when count(*) filter (comparator is null or gaps > 0) = 0 then product(1 + candidate) - product(1 + comparator) end > 0 as beats from ({_SEC}) group by 1""",
)
def _(t):
    g = pool_levels(t).groupBy("entity_id", "split_id").agg(
        (F.max_by("level", "session") / F.min_by("level", "session") - 1).alias("candidate"),
        (F.max_by("plevel", "session") / F.min_by("plevel", "session") - 1).alias("_p"),
        F.count_if(F.col("volume") % 997 == 3).alias("gaps"),
    )
    return ev.pooled_secondary(g.withColumn("comparator", F.when(F.col("_p") < 1.5, F.col("_p"))), ["entity_id"])


@query(
    "pooled_drawdown", "entity_id:s candidate_drawdown:f7 primary_drawdown:f7 clears:b",
    """with d as (select entity_id, chained / max(chained) over w - 1 as c, pchained / max(pchained) over w - 1 as p from pool_chained
         window w as (partition by entity_id order by session rows unbounded preceding)),
       m as (select entity_id, min(c) as candidate_drawdown, min(p) as primary_drawdown from d group by 1)
       select m.*, case when coalesce(gapped, 0) = 0 then abs(candidate_drawdown) <= abs(primary_drawdown) * 0.75 end as clears from m left join pool_gaps using (entity_id)""",
)
def _(t):
    lv = pool_levels(t)
    a = ev.chain_link_levels(lv, ["entity_id"]).withColumnRenamed("chained", "candidate").drop("level")
    b = ev.chain_link_levels(a.withColumnRenamed("plevel", "level"), ["entity_id"]).withColumnRenamed("chained", "primary")
    return ev.pooled_drawdown(b, pool_gaps(t), 0.75, ["entity_id"])


@query(
    "verdict_3vl", "experiment:i verdict:s promotion_met:b mixed_case:b",
    """with x as (select experiment, n > 8 as complete, case when k % 4 = 0 then null else k % 4 = 1 end as passes, case when k % 5 = 0 then null else k % 5 < 3 end as beats,
         case when k % 3 = 0 then null else k % 3 = 1 end as clears from metric_rows)
       select experiment, case when not complete then 'UNMEASURED' when coalesce(passes, false) or coalesce(beats, false) then 'OWNER_REVIEW'
           when passes = false and beats = false then 'REJECT' else 'UNMEASURED' end as verdict,
         case when not complete then null when passes = false or clears = false then false when passes and clears then true end as promotion_met,
         complete and coalesce(passes = false, false) and coalesce(beats, false) as mixed_case from x""",
)
def _(t):
    k = F.col("k")
    x = metric_rows(t).select(
        "experiment", (F.col("n") > 8).alias("complete"), F.when(k % 4 != 0, k % 4 == 1).alias("passes"),
        F.when(k % 5 != 0, k % 5 < 3).alias("beats"), F.when(k % 3 != 0, k % 3 == 1).alias("clears"),
    )
    return ev.verdict(x)


@query(
    "citability", "experiment:i blocking:s why:s citable:b",
    """with s as (select o_custkey as experiment, case when o_orderpriority = '1-URGENT' and o_orderkey % 3 = 0 then 'SURVIVORSHIP_BIASED' when o_orderpriority = '2-HIGH' and o_orderkey % 3 = 0
           then 'OPTIMISTIC_DELAY' end as code, o_orderkey % 11 <> 0 as citable from orders),
       g as (select experiment, coalesce(string_agg(distinct code, ',' order by code), '') as blocking, count(*) filter (not citable) as bad, count(*) as n from s group by 1)
       select experiment, blocking, concat_ws(',', case when bad > 0 then 'SPLIT_NOT_CITABLE' end, case when blocking <> '' then 'BLOCKING_LABEL' end, case when n <= 5 then 'INCOMPLETE_POOL' end) as why,
         bad = 0 and blocking = '' and n > 5 as citable from g""",
)
def _(t):
    pri, third = F.col("o_orderpriority"), F.col("o_orderkey") % 3 == 0
    code = F.when((pri == "1-URGENT") & third, "SURVIVORSHIP_BIASED").when((pri == "2-HIGH") & third, "OPTIMISTIC_DELAY").otherwise("GAP")
    s = t.orders.select(F.col("o_custkey").alias("experiment"), F.array(code).alias("labels"), (F.col("o_orderkey") % 11 != 0).alias("citable"))
    complete = s.groupBy("experiment").agg((F.count(F.lit(1)) > 5).alias("complete"))
    out = ev.citability(s, complete, ["experiment"])
    return out.withColumn("blocking", F.array_join("blocking", ",")).withColumn("why", F.array_join("why", ","))


SQL_VIEWS["exps"] = """
select c_custkey as experiment, nullif(c_custkey // 2, c_custkey) as parent, c_nationkey as strategy, date '1996-01-01' + cast(c_custkey % 1500 as int) as registered_at,
  case when c_custkey % 7 = 0 then date '1996-01-01' + cast(c_custkey % 1500 + 200 as int) end as viewed_at,
  case when c_custkey % 3 = 0 then date '1996-01-01' + cast(c_custkey % 1500 + 300 as int) end as holdout_opened_at,
  date '1997-01-01' + cast(c_custkey % 900 as int) as holdout_start, date '1997-01-01' + cast(c_custkey % 900 + 180 as int) as holdout_end,
  c_custkey % 5 = 0 as declares_opened, c_acctbal < 0 as biased from customer"""


def exps(t):
    k = F.col("c_custkey")
    day = (k % 1500).cast("int")

    def on(base, plus=0):
        return F.date_add(F.lit(base).cast("date"), day + plus)

    hold = (k % 900).cast("int")
    start = F.lit("1997-01-01").cast("date")
    # The lowest keys are the roots of their chains; a parent that is missing ends a chain too.
    parent = F.nullif(F.floor(k / 2), k)
    return t.customer.select(
        k.alias("experiment"), parent.alias("parent"), F.col("c_nationkey").alias("strategy"), on("1996-01-01").alias("registered_at"),
        F.when(k % 7 == 0, on("1996-01-01", 200)).alias("viewed_at"), F.when(k % 3 == 0, on("1996-01-01", 300)).alias("holdout_opened_at"),
        F.date_add(start, hold).alias("holdout_start"), F.date_add(start, hold + 180).alias("holdout_end"), (k % 5 == 0).alias("declares_opened"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("SURVIVORSHIP_BIASED"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        (k % 3 == 0).alias("holdout_opened"), (k % 21 == 0).alias("claimed"),
        F.array(F.lit("B0"), F.concat(F.lit("A"), k % 3)).alias("arms"), F.concat(F.lit("c"), k % 10).alias("commit"),
        F.array(F.concat(F.lit("s"), k % 4), F.concat(F.lit("s"), k % 4 + 1)).alias("snapshots"),
    )


def exp_trials(t):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return t.orders.select(
        k.alias("experiment"), o.alias("trial_id"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (o % 13 == 0), F.array(F.lit("OPTIMISTIC_DELAY"))).otherwise(F.array(F.lit("GAP"))).alias("labels"),
        F.concat(F.lit("A"), o % 3).alias("arm"), F.concat(F.lit("c"), F.when(o % 17 == 0, o % 10).otherwise(k % 10)).alias("commit"),
        F.when(o % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), k % 4 + o % 3))).alias("snapshot_ids"),
        F.col("o_orderdate").alias("started"), F.date_add(F.col("o_orderdate").cast("date"), (o % 23).cast("int") - 1).cast("timestamp_ntz").alias("finished"),
    )


@query(
    "trial_chain_count", "experiment:i chain_trials:i state:s",
    """with recursive x as (select experiment, case when experiment = 5 then 23 when experiment = 7 then 7 else parent end as parent from exps),
       chain as (select experiment, experiment as node, parent from x union select c.experiment, x.experiment, x.parent from chain c join x on x.experiment = c.parent)
       select experiment, cast(sum(coalesce(n, 0)) as bigint) as chain_trials, case when count(*) filter (parent is null or parent not in (select experiment from x)) = 0 then 'CYCLE' else 'ROOTED' end as state
       from chain left join (select o_custkey as node, count(*) as n from orders group by 1) using (node) group by 1""",
)
def _(t):
    # Two planted cycles: 5 -> 23 -> 11 -> 5, and 7 is its own parent.
    k = F.col("experiment")
    e = exps(t).withColumn("parent", F.when(k == 5, F.lit(23)).when(k == 7, F.lit(7)).otherwise(F.col("parent")))
    return ev.trial_chain_count(e, exp_trials(t))


@query(
    "promotion_eligibility", "experiment:i blocking:s eligible:b",
    """with c as (select experiment, 'SURVIVORSHIP_BIASED' as code from exps where biased union select o_custkey, 'OPTIMISTIC_DELAY' from orders where o_orderpriority = '1-URGENT' and o_orderkey % 13 = 0)
       select e.experiment, coalesce(string_agg(code, ',' order by code), '') as blocking, count(code) = 0 and e.experiment % 3 = 0 as eligible from exps e left join c using (experiment) group by 1""",
)
def _(t):
    out = ev.promotion_eligibility(exps(t), exp_trials(t))
    return out.withColumn("blocking", F.array_join("blocking", ","))


@query(
    "trial_conformance", "trial_id:i experiment:i why:s",
    """select * from (select o_orderkey as trial_id, o_custkey as experiment, concat_ws(',', case when o_orderkey % 17 = 0 and o_orderkey % 10 <> o_custkey % 10 then 'COMMIT_MISMATCH' end,
         case when o_orderkey % 3 <> o_custkey % 3 then 'ARM_NOT_DECLARED' end, case when o_orderkey % 19 <> 0 and o_orderkey % 3 = 2 then 'SNAPSHOT_NOT_REGISTERED' end,
         case when o_orderkey % 19 = 0 then 'NO_SNAPSHOT' end, case when o_orderkey % 23 = 0 then 'REVERSED_TIMES' end) as why from orders join exps on experiment = o_custkey) where why <> ''""",
)
def _(t):
    return ev.trial_conformance(exp_trials(t), exps(t)).withColumn("why", F.array_join("why", ","))


@query(
    "experiment_lineage_violations", "experiment:i why:s",
    """select * from (select e.experiment, concat_ws(',', case when e.parent is null and exists (select 1 from exps s where s.strategy = e.strategy and s.viewed_at < e.registered_at) then 'PARENT_REQUIRED' end,
         case when p.holdout_opened_at is not null and e.holdout_start <= p.holdout_end and not e.declares_opened then 'HOLDOUT_INHERITED' end) as why
         from (select * replace (case when experiment % 6 = 1 then null else parent end as parent) from exps) e left join exps p on p.experiment = e.parent) where why <> ''""",
)
def _(t):
    e = exps(t)
    roots = e.withColumn("parent", F.when(F.col("experiment") % 6 != 1, F.col("parent")))
    return ev.lineage_violations(roots).withColumn("why", F.array_join("why", ","))


@query(
    "viewed_holdout_status", "strategy:i experiments:i trials:i viewed:i opened:i claimed:i",
    """select strategy, count(*) as experiments, coalesce(sum(n), 0) as trials, count(viewed_at) as viewed, count(holdout_opened_at) as opened, count(*) filter (experiment % 21 = 0) as claimed
       from exps left join (select o_custkey as experiment, count(*) as n from orders group by 1) using (experiment) group by 1""",
)
def _(t):
    return ev.holdout_status(exps(t), exp_trials(t))
