"""Candidate selection, sizing and order queries."""

from pyspark.sql import functions as F

from knownwhen.operators import selection as sel
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS

P = sel.BookParams(min_adv=200000.0)
S = sel.SizingParams()
NAV = 1.0e7

SQL_VIEWS["cand_rows"] = """
select *, case when decision % 100 = 3 then null else cast(dsum as double) / dn / 100 - 0.008 end as cash_mom from (
  select *, sum(cents) over (partition by trial, decision) as dsum, sum(n) over (partition by trial, decision) as dn from (
    select l_suppkey % 5 as trial, year(l_shipdate) * 100 + month(l_shipdate) as decision, p_brand as entity_id, count(*) as n,
      sum(cast(round(l_discount * 100) as bigint)) as cents,
      cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 100 as mom,
      cast(sum(l_quantity) as bigint) % 6 <> 0 as trend,
      case when cast(sum(l_quantity) as bigint) % 23 <> 0 then (cast(sum(l_quantity) as bigint) % 37 + 5) / 100.0 end as vol,
      cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as adv, min(l_extendedprice) as px,
      count(*) % 2 = 0 as held, cast(sum(l_quantity) as bigint) % 31 = 0 as restricted, cast(sum(l_quantity) as bigint) % 50 as shares
    from lineitem join part on p_partkey = l_partkey group by 1, 2, 3))"""
SQL_VIEWS["cand_clusters"] = """
select distinct p_brand as entity_id, concat('C', cast(replace(p_brand, 'Brand#', '') as int) % 6) as cluster_id, 2 as max_members
from part where cast(replace(p_brand, 'Brand#', '') as int) % 6 < 4"""
SQL_VIEWS["cand_ranked"] = """
select *, case when rejection is null then row_number() over (partition by trial, decision, rejection is null order by mom desc, entity_id) end as rnk
from (select *, case when restricted then 'COMPLIANCE_RESTRICTED'
    when mom is null or trend is null or vol is null or px is null or adv is null then 'NO_FEATURES'
    when cash_mom is null then 'CASH_HURDLE_UNAVAILABLE' when not trend then 'TREND_DOWN' when mom <= cash_mom then 'MOMENTUM_BELOW_CASH'
    when adv < 200000 then 'BELOW_ADV_FLOOR' end as rejection from cand_rows)"""
SQL_VIEWS["cand_banded"] = """
select *, coalesce(rnk <= case when held then 7 else 5 end, false) as in_band,
  case when rnk > case when held then 7 else 5 end then case when held then 'RANK_BELOW_HOLD' else 'RANK_BELOW_ENTRY' end end as band_reason
from cand_ranked"""
SQL_VIEWS["cand_capped"] = """
select *, in_band and cluster_id is not null and cr > max_members as cluster_full from (
  select b.*, cluster_id, max_members, count(*) filter (in_band) over (partition by trial, decision, cluster_id order by rnk) as cr
  from cand_banded b left join cand_clusters c using (entity_id))"""
SQL_VIEWS["cand_filled"] = """
select *, case when not cleared then null when held and place <= 5 then 'HOLD' when held then 'EXIT_FULL'
    when least(inc, 5) + least(place - 1, 2) >= 5 then 'FULL' when place > 2 then 'NEW_POSITION_CAP' else 'ENTER' end as fill
from (select *, row_number() over (partition by trial, decision, cleared, held order by rnk) as place,
    count(*) filter (cleared and held) over (partition by trial, decision) as inc
  from (select *, in_band and not cluster_full as cleared from cand_capped))"""
# The backfill pass one candidate at a time, as a recursion over the waiting list of each decision.
SQL_VIEWS["backfill_wait"] = """
select f.*, row_number() over (partition by trial, decision order by rnk) as pos,
  (select count(*) from cand_filled x where x.trial = f.trial and x.decision = f.decision and x.fill in ('HOLD', 'ENTER')) as sel0,
  (select count(*) from cand_filled x where x.trial = f.trial and x.decision = f.decision and x.fill = 'ENTER') as new0,
  (select count(*) from cand_filled x where x.trial = f.trial and x.decision = f.decision and x.cluster_id = f.cluster_id and x.cleared) as used0
from cand_filled f where band_reason = 'RANK_BELOW_ENTRY' and rnk <= 7
  and exists (select 1 from cand_filled x where x.trial = f.trial and x.decision = f.decision and x.cluster_full)"""
SQL_VIEWS["backfill_steps"] = """
select trial, decision, cast(0 as bigint) as pos, cast('' as varchar) as entity_id, cast(null as varchar) as outcome, min(sel0) as s, min(new0) as e,
  cast([] as varchar[]) as taken from backfill_wait group by 1, 2
union all
select w.trial, w.decision, w.pos, w.entity_id,
  case when b.s >= 5 then 'STOP' when w.cluster_id is not null and w.used0 + len(list_filter(b.taken, lambda x: x = w.cluster_id)) >= w.max_members
    then 'CLUSTER_FULL' when b.e >= 2 then 'NEW_POSITION_CAP' else 'ENTER' end as outcome,
  b.s + case when b.s < 5 and b.e < 2 and not (w.cluster_id is not null and w.used0 + len(list_filter(b.taken, lambda x: x = w.cluster_id)) >= w.max_members) then 1 else 0 end,
  b.e + case when b.s < 5 and b.e < 2 and not (w.cluster_id is not null and w.used0 + len(list_filter(b.taken, lambda x: x = w.cluster_id)) >= w.max_members) then 1 else 0 end,
  case when b.s < 5 and b.e < 2 and not (w.cluster_id is not null and w.used0 + len(list_filter(b.taken, lambda x: x = w.cluster_id)) >= w.max_members)
    then list_append(b.taken, coalesce(w.cluster_id, '-')) else b.taken end
from backfill_steps b join backfill_wait w on w.trial = b.trial and w.decision = b.decision and w.pos = b.pos + 1"""
SQL_VIEWS["cand_log"] = """
select f.*, case when b.outcome = 'ENTER' then 'ENTER' when fill in ('HOLD', 'ENTER') then fill when held then 'EXIT' else 'STAY_OUT' end as action,
  case when b.outcome = 'ENTER' then 'ELIGIBLE_BACKFILL_AFTER_CLUSTER_SKIP' when b.outcome in ('CLUSTER_FULL', 'NEW_POSITION_CAP') then b.outcome
    when fill = 'HOLD' then 'ELIGIBLE_WITHIN_HOLD_RANK' when fill = 'ENTER' then 'ELIGIBLE_WITHIN_ENTRY_RANK'
    when fill = 'NEW_POSITION_CAP' then fill when fill = 'EXIT_FULL' then 'RANK_BELOW_HOLD' when fill = 'FULL' then 'RANK_BELOW_ENTRY'
    when cluster_full then 'CLUSTER_FULL' else coalesce(band_reason, rejection) end as reason
from cand_filled f left join backfill_steps b on b.trial = f.trial and b.decision = f.decision and b.entity_id = f.entity_id and b.pos > 0"""
# Cap by repeating the redistribution, as the rule is stated.
SQL_VIEWS["raw_weights"] = """
select trial, decision, entity_id, vol, px, shares, (1 / vol) / sum(1 / vol) over (partition by trial, decision) as raw_weight
from cand_log where action in ('HOLD', 'ENTER')"""
SQL_VIEWS["cap_steps"] = """
select trial, decision, entity_id, raw_weight as w, false as capped, 0 as step from raw_weights
union all
select trial, decision, entity_id, case when w > 0.2 then 0.2 when capped then w
    when ot > 0 then w + excess * w / ot else w end, capped or w > 0.2, step + 1
from (select *, sum(case when w > 0.2 then w - 0.2 else 0 end) over (partition by trial, decision) as excess,
    sum(case when not capped and w <= 0.2 then w end) over (partition by trial, decision) as ot from cap_steps where step < 6)"""
SQL_VIEWS["capped_weights"] = """
select r.*, w as capped_weight from raw_weights r join cap_steps c using (trial, decision, entity_id) where step = 6"""
SQL_VIEWS["brand_days"] = """
select year(l_shipdate) * 100 + month(l_shipdate) as decision, p_brand as entity_id, cast(l_shipdate as date) as session,
  (cast(sum(l_quantity) as bigint) % 21 - 10) / 1000.0 as log_return
from lineitem join part on p_partkey = l_partkey group by 1, 2, 3"""
SQL_VIEWS["scaled_weights"] = """
select c.*, sigma, case when sigma > 0 then least(1, 0.1 / sigma) else 1 end as vol_scale,
  capped_weight * case when sigma > 0 then least(1, 0.1 / sigma) else 1 end as scaled_weight
from capped_weights c left join (select trial, decision, sqrt(var_samp(r) * 252) as sigma from (
  select trial, decision, session, sum(capped_weight * log_return) as r from capped_weights join brand_days using (decision, entity_id) group by 1, 2, 3)
  group by 1, 2) using (trial, decision)"""
SQL_VIEWS["target_weights"] = """
select *, scaled_weight * case when t > 0.98 then 0.98 / t else 1 end as weight, 1 - t * case when t > 0.98 then 0.98 / t else 1 end as cash_weight
from (select *, sum(scaled_weight) over (partition by trial, decision) as t from scaled_weights)"""
SQL_VIEWS["share_rows"] = """
select *, cast(floor(10000000.0 * weight / px) as bigint) as target_shares, floor(10000000.0 * weight / px) * px / 10000000.0 as achieved_weight
from target_weights"""


def cand_rows(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    day = F.col("l_shipdate")
    g = t.lineitem.join(p, "l_partkey").groupBy(
        (F.col("l_suppkey") % 5).alias("trial"), (F.year(day) * 100 + F.month(day)).cast("bigint").alias("decision"), "entity_id"
    )
    n, q = F.col("n"), F.col("q")
    rows = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("cents"),
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("adv"),
        F.min("l_extendedprice").alias("px"),
    )
    w = sel.Window.partitionBy("trial", "decision")
    hurdle = F.sum("cents").over(w).cast("double") / F.sum("n").over(w) / 100 - 0.008
    return rows.select(
        "trial", "decision", "entity_id", "adv", "px",
        (F.col("cents").cast("double") / n / 100).alias("mom"),
        (q % 6 != 0).alias("trend"),
        F.when(q % 23 != 0, (q % 37 + 5) / 100.0).alias("vol"),
        (n % 2 == 0).alias("held"),
        (q % 31 == 0).alias("restricted"),
        (q % 50).alias("shares"),
        F.when(F.col("decision") % 100 != 3, hurdle).alias("cash_mom"),
    )


def clusters(t):
    n = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int") % 6
    out = t.part.where(n < 4).select(F.col("p_brand").alias("entity_id"), F.concat(F.lit("C"), n).alias("cluster_id")).distinct()
    return out.withColumn("max_members", F.lit(2))


def log(t):
    return sel.candidate_log(sel.select_candidates(cand_rows(t), clusters(t), P))


def book(t):
    return log(t).where(F.col("action").isin("HOLD", "ENTER"))


def capped(t):
    return sel.cap_redistribute(sel.inverse_vol_weights(book(t)), S.cap)


def brand_days(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    day = F.col("l_shipdate").cast("date")
    g = t.lineitem.join(p, "l_partkey").groupBy("entity_id", day.alias("session")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    dec = (F.year("session") * 100 + F.month("session")).cast("bigint")
    return g.select(dec.alias("decision"), "entity_id", "session", ((F.col("q") % 21 - 10) / 1000.0).alias("log_return"))


def scaled(t):
    c = capped(t)
    return sel.vol_target_scale(c, sel.book_vol(c, brand_days(t)), S.vol_target)


def targets(t):
    return sel.share_targets(sel.cash_floor(scaled(t), S), F.lit(NAV))


_K = "trial:i decision:i entity_id:s "


@query("eligibility", _K + "rejection:s", "select trial, decision, entity_id, rejection from cand_ranked")
def _(t):
    return sel.eligibility(cand_rows(t), P)


@query("momentum_rank", _K + "mom:f6 rank:i", "select trial, decision, entity_id, mom, rnk as rank from cand_ranked where rnk is not null")
def _(t):
    return sel.momentum_rank(sel.eligibility(cand_rows(t), P)).where("rank is not null")


@query("rank_band", _K + "in_band:b band_reason:s", "select trial, decision, entity_id, in_band, band_reason from cand_banded")
def _(t):
    return sel.rank_band(sel.momentum_rank(sel.eligibility(cand_rows(t), P)), P)


@query("cluster_cap", _K + "cluster_id:s cluster_full:b", "select trial, decision, entity_id, cluster_id, cluster_full from cand_capped")
def _(t):
    return sel.cluster_cap(sel.rank_band(sel.momentum_rank(sel.eligibility(cand_rows(t), P)), P), clusters(t))


@query("book_fill", _K + "fill:s", "select trial, decision, entity_id, fill from cand_filled")
def _(t):
    c = sel.cluster_cap(sel.rank_band(sel.momentum_rank(sel.eligibility(cand_rows(t), P)), P), clusters(t))
    return sel.book_fill(c, P)


@query(
    "cluster_backfill", _K + "outcome:s",
    "select trial, decision, entity_id, outcome from backfill_steps where pos > 0 and outcome <> 'STOP'",
)
def _(t):
    out = sel.select_candidates(cand_rows(t), clusters(t), P).where("backfill_reason is not null")
    return out.withColumn("outcome", F.when(F.col("backfilled"), "ENTER").otherwise(F.col("backfill_reason")))


@query("candidate_log", _K + "rank:i action:s reason:s", "select trial, decision, entity_id, rnk as rank, action, reason from cand_log")
def _(t):
    return log(t)


@query("candidate_exits", _K.strip(), "select trial, decision, entity_id from cand_log where held and action not in ('HOLD', 'ENTER')")
def _(t):
    rows = cand_rows(t)
    picked = sel.candidate_log(sel.select_candidates(rows, clusters(t), P))
    return sel.exits(rows.where("held").select("trial", "decision", "entity_id"), picked)


@query("inverse_vol_weights", _K + "raw_weight:f8", "select trial, decision, entity_id, raw_weight from raw_weights")
def _(t):
    return sel.inverse_vol_weights(book(t))


@query("cap_redistribute", _K + "capped_weight:f8", "select trial, decision, entity_id, capped_weight from capped_weights")
def _(t):
    return capped(t)


@query(
    "vol_target_scale", _K + "sigma:f7 vol_scale:f7 scaled_weight:f7",
    "select trial, decision, entity_id, sigma, vol_scale, scaled_weight from scaled_weights",
)
def _(t):
    return scaled(t)


@query("cash_floor", _K + "weight:f7 cash_weight:f7", "select trial, decision, entity_id, weight, cash_weight from target_weights")
def _(t):
    return sel.cash_floor(scaled(t), S)


@query(
    "share_targets", _K + "target_shares:i achieved_weight:f9",
    "select trial, decision, entity_id, target_shares, achieved_weight from share_rows",
)
def _(t):
    return targets(t)


@query(
    "rebalance_orders", _K + "delta_shares:i current_shares:i target_shares:i gap_pct:f9 reason:s",
    """with c as (select trial, decision, entity_id, shares, px from cand_rows where held and shares > 0),
       j as (select trial, decision, entity_id, coalesce(t.target_shares, 0) as target_shares, coalesce(c.shares, 0) as current_shares,
         t.target_shares is null as gone, abs(coalesce(achieved_weight, 0) - coalesce(c.shares, 0) * coalesce(t.px, c.px) / 10000000.0) * 100 as gap_pct
         from share_rows t full join c using (trial, decision, entity_id))
       select trial, decision, entity_id, target_shares - current_shares as delta_shares, current_shares, target_shares, gap_pct,
         case when gone then 'EXIT' when current_shares <= 0 then 'ENTRY' else 'BAND_EXCEEDED' end as reason
       from j where target_shares <> current_shares and (gone or current_shares <= 0 or gap_pct > 2)""",
)
def _(t):
    current = cand_rows(t).where("held").select("trial", "decision", "entity_id", "shares", "px")
    return sel.rebalance_orders(targets(t), current, F.lit(NAV), 2.0)


@query(
    "factor_tags", "entity_id:s factors:s classified:b",
    """select m.entity_id, coalesce(string_agg(distinct p_type, ',' order by p_type), '') as factors, count(p_type) > 0 as classified
       from (select distinct p_brand as entity_id from part union select distinct p_type from part) m left join part p on p.p_brand = m.entity_id
       group by 1""",
)
def _(t):
    # Types carry no tags themselves: they are the members without a class.
    members = t.part.select(F.explode(F.array("p_brand", "p_type")).alias("entity_id")).distinct()
    tags = t.part.select(F.col("p_brand").alias("entity_id"), F.col("p_type").alias("factor"))
    return sel.factor_tags(members, tags).withColumn("factors", F.array_join("factors", ","))
