"""Eligibility, ranking, book filling, sizing and orders for many trials and decisions.

Rows are (trial, decision, entity); a (trial, decision) group is one universe, so the
windows here are bounded by its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import first_true, ratio
from knownwhen.operators.features import SESSIONS_PER_YEAR

GROUP = ("trial", "decision")


@dataclass(frozen=True)
class BookParams:
    entry_rank: int = 5
    hold_rank: int = 7
    max_positions: int = 5
    max_new: int = 2
    min_adv: float = 0.0


@dataclass(frozen=True)
class SizingParams:
    cap: float = 0.20
    min_cash: float = 0.02
    max_gross: float = 1.0
    vol_target: float = 0.10


def eligibility(rows: DataFrame, p: BookParams) -> DataFrame:
    """First rule a candidate fails, in fixed order; null means eligible."""
    missing = F.lit(False)
    for x in ("mom", "trend", "vol", "px", "adv"):
        missing = missing | F.col(x).isNull()
    why = first_true(
        (F.coalesce(F.col("restricted"), F.lit(False)), "COMPLIANCE_RESTRICTED"),
        (missing, "NO_FEATURES"),
        (F.col("cash_mom").isNull(), "CASH_HURDLE_UNAVAILABLE"),
        (~F.col("trend"), "TREND_DOWN"),
        (F.col("mom") <= F.col("cash_mom"), "MOMENTUM_BELOW_CASH"),
        (F.col("adv") < p.min_adv, "BELOW_ADV_FLOOR"),
    )
    return rows.withColumn("rejection", why)


def momentum_rank(rows: DataFrame) -> DataFrame:
    """Rank of eligible rows by momentum, entity id breaking ties; null for the rest."""
    ok = F.col("rejection").isNull()
    w = Window.partitionBy(*GROUP, ok).orderBy(F.col("mom").desc(), "entity_id")
    return rows.withColumn("rank", F.when(ok, F.row_number().over(w)))


def rank_band(rows: DataFrame, p: BookParams) -> DataFrame:
    limit = F.when(F.col("held"), p.hold_rank).otherwise(p.entry_rank)
    reason = F.when(F.col("held"), "RANK_BELOW_HOLD").otherwise("RANK_BELOW_ENTRY")
    out = rows.withColumn("in_band", F.coalesce(F.col("rank") <= limit, F.lit(False)))
    return out.withColumn("band_reason", F.when(F.col("rank").isNotNull() & ~F.col("in_band"), reason))


def cluster_cap(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Keep the best members of each cluster strictly by rank; others are unaffected."""
    out = rows.join(clusters.select("entity_id", "cluster_id", "max_members"), "entity_id", "left")
    w = Window.partitionBy(*GROUP, "cluster_id", "in_band").orderBy("rank")
    full = F.col("in_band") & F.col("cluster_id").isNotNull() & (F.row_number().over(w) > F.col("max_members"))
    return out.withColumn("cluster_full", F.coalesce(full, F.lit(False)))


def book_fill(rows: DataFrame, p: BookParams) -> DataFrame:
    """Incumbents by rank, then newcomers, to the position and new-position limits."""
    cleared = F.col("in_band") & ~F.col("cluster_full")
    out = rows.withColumn("cleared", cleared)
    w = Window.partitionBy(*GROUP)
    place = F.row_number().over(Window.partitionBy(*GROUP, "cleared", "held").orderBy("rank"))
    out = out.withColumn("_place", F.when(cleared, place)).withColumn(
        "_inc", F.least(F.sum(F.when(cleared & F.col("held"), 1).otherwise(0)).over(w), F.lit(p.max_positions))
    )
    before = F.col("_inc") + F.least(F.col("_place") - 1, F.lit(p.max_new))
    new = cleared & ~F.col("held")
    fill = first_true(
        (cleared & F.col("held") & (F.col("_place") <= p.max_positions), "HOLD"),
        (cleared & F.col("held"), "EXIT_FULL"),
        (new & (before >= p.max_positions), "FULL"),
        (new & (F.col("_place") > p.max_new), "NEW_POSITION_CAP"),
        (new, "ENTER"),
    )
    return out.withColumn("fill", fill).drop("_place", "_inc")


def cluster_backfill(rows: DataFrame, p: BookParams) -> DataFrame:
    """Fill slots a cluster skip left open from ranks up to the hold rank.

    Later picks depend on earlier ones only through counts, so it is closed form: a
    candidate passes its cluster by its place within it, and the slots by its place
    among those that pass.
    """
    w = Window.partitionBy(*GROUP)
    picked = F.col("fill").isin("HOLD", "ENTER")
    out = (
        rows.withColumn("_skip", F.max("cluster_full").over(w))
        .withColumn("_sel", F.sum(picked.cast("int")).over(w))
        .withColumn("_new", F.coalesce(F.sum((F.col("fill") == "ENTER").cast("int")).over(w), F.lit(0)))
        .withColumn("_used", F.sum(F.col("cleared").cast("int")).over(Window.partitionBy(*GROUP, "cluster_id")))
    )
    open_ = F.col("_skip") & (F.coalesce("_sel", F.lit(0)) < p.max_positions) & (F.col("rank") <= p.hold_rank)
    out = out.withColumn("_cand", F.coalesce(open_ & (F.col("band_reason") == "RANK_BELOW_ENTRY"), F.lit(False)))
    in_cluster = F.row_number().over(Window.partitionBy(*GROUP, "cluster_id", "_cand").orderBy("rank"))
    free = F.col("cluster_id").isNull() | (F.col("_used") + in_cluster <= F.col("max_members"))
    out = out.withColumn("_pass", F.col("_cand") & free)
    place = F.row_number().over(Window.partitionBy(*GROUP, "_pass").orderBy("rank"))
    base = F.coalesce("_sel", F.lit(0))
    fits = (base + place <= p.max_positions) & (F.col("_new") + place <= p.max_new)
    out = out.withColumn("backfilled", F.col("_pass") & fits)
    upto = Window.partitionBy(*GROUP).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    upto_c = Window.partitionBy(*GROUP, "cluster_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    took = F.col("backfilled").cast("int")
    done = F.coalesce(F.sum(took).over(upto), F.lit(0))
    done_c = F.coalesce(F.sum(took).over(upto_c), F.lit(0))
    left = F.col("_cand") & ~F.col("backfilled") & (base + done < p.max_positions)
    reason = F.when(F.col("backfilled"), "ELIGIBLE_BACKFILL_AFTER_CLUSTER_SKIP").when(
        left,
        F.when(F.col("cluster_id").isNotNull() & (F.col("_used") + done_c >= F.col("max_members")), "CLUSTER_FULL").otherwise(
            "NEW_POSITION_CAP"
        ),
    )
    return out.withColumn("backfill_reason", reason).drop("_skip", "_sel", "_new", "_used", "_cand", "_pass")


def select_candidates(rows: DataFrame, clusters: DataFrame, p: BookParams) -> DataFrame:
    """All selection passes for rows that already say what is held."""
    out = rank_band(momentum_rank(eligibility(rows, p)), p)
    return cluster_backfill(book_fill(cluster_cap(out, clusters), p), p)


def candidate_log(selected: DataFrame) -> DataFrame:
    """Every entity with its action and deciding reason."""
    out_of = F.when(F.col("held"), "EXIT").otherwise("STAY_OUT")
    action = (
        F.when(F.col("backfilled"), "ENTER")
        .when(F.col("fill").isin("HOLD", "ENTER"), F.col("fill"))
        .otherwise(out_of)
    )
    reason = F.coalesce(
        F.col("backfill_reason"),
        F.when(F.col("fill") == "HOLD", "ELIGIBLE_WITHIN_HOLD_RANK")
        .when(F.col("fill") == "ENTER", "ELIGIBLE_WITHIN_ENTRY_RANK")
        .when(F.col("fill") == "NEW_POSITION_CAP", "NEW_POSITION_CAP")
        .when(F.col("fill") == "EXIT_FULL", "RANK_BELOW_HOLD")
        .when(F.col("fill") == "FULL", "RANK_BELOW_ENTRY"),
        F.when(F.col("cluster_full"), "CLUSTER_FULL"),
        F.col("band_reason"),
        F.col("rejection"),
    )
    return selected.withColumn("action", action).withColumn("reason", reason)


def exits(held: DataFrame, log: DataFrame) -> DataFrame:
    """Held lines that the decision did not keep."""
    kept = log.where(F.col("action").isin("HOLD", "ENTER")).select(*GROUP, "entity_id")
    return held.join(kept, [*GROUP, "entity_id"], "left_anti")


def inverse_vol_weights(book: DataFrame) -> DataFrame:
    """1/vol normalised over sizable names; a missing or zero vol leaves a name unsized."""
    ok = F.coalesce(F.col("vol") > 0, F.lit(False))
    inv = F.when(ok, 1 / F.col("vol"))
    return book.withColumn("unsized", ~ok).withColumn("raw_weight", inv / F.sum(inv).over(Window.partitionBy(*GROUP)))


def cap_redistribute(weighted: DataFrame, cap: float) -> DataFrame:
    """Cap per name with the excess pro rata to the uncapped, to a fixpoint.

    Closed form: with weights in descending order the k largest are capped and the rest
    scaled by (1 - k cap) / (1 - sum of those k), for the smallest k at which the next
    weight fits. What cannot be placed goes to cash.
    """
    w = Window.partitionBy(*GROUP)
    down = w.orderBy(F.col("raw_weight").desc_nulls_last(), "entity_id")
    k = F.row_number().over(down) - 1
    cum = F.coalesce(F.sum("raw_weight").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = weighted.withColumn("_k", k).withColumn("_s", ratio(1 - F.col("_k") * cap, 1 - cum))
    fits = F.col("raw_weight") * F.col("_s") <= cap
    out = out.withColumn("_kmin", F.min(F.when(fits, F.col("_k"))).over(w))
    out = out.withColumn("_scale", F.max(F.when(F.col("_k") == F.col("_kmin"), F.col("_s"))).over(w))
    capped = F.col("_kmin").isNull() | (F.col("_k") < F.col("_kmin"))
    weight = F.when(F.col("raw_weight").isNull(), None).when(capped, F.lit(cap)).otherwise(F.col("raw_weight") * F.col("_scale"))
    return out.withColumn("capped_weight", weight).drop("_k", "_s", "_kmin", "_scale")


def book_vol(weighted: DataFrame, returns: DataFrame, weight: str = "capped_weight") -> DataFrame:
    """Ex-ante volatility of each book from aligned returns (decision, entity, session, log_return)."""
    w = weighted.select(*GROUP, "entity_id", F.col(weight).alias("_w")).join(returns, ["decision", "entity_id"])
    day = w.groupBy(*GROUP, "session").agg(F.sum(F.col("_w") * F.col("log_return")).alias("_r"))
    return day.groupBy(*GROUP).agg(F.sqrt(F.var_samp("_r") * SESSIONS_PER_YEAR).alias("sigma"))


def vol_target_scale(weighted: DataFrame, sigma: DataFrame, target: float) -> DataFrame:
    """k = min(1, target / sigma); a missing or zero sigma leaves the book unscaled."""
    out = weighted.join(sigma, list(GROUP), "left")
    k = F.when(F.col("sigma") > 0, F.least(F.lit(1.0), target / F.col("sigma"))).otherwise(1.0)
    return out.withColumn("vol_scale", k).withColumn("scaled_weight", F.col("capped_weight") * F.col("vol_scale"))


def cash_floor(weighted: DataFrame, p: SizingParams) -> DataFrame:
    """Shrink pro rata to the invested ceiling; cash is what remains."""
    ceiling = min(1 - p.min_cash, p.max_gross)
    w = Window.partitionBy(*GROUP)
    total = F.coalesce(F.sum("scaled_weight").over(w), F.lit(0.0))
    out = weighted.withColumn("_t", total)
    shrink = F.when(F.col("_t") > ceiling, F.lit(ceiling) / F.col("_t")).otherwise(1.0)
    out = out.withColumn("weight", F.col("scaled_weight") * shrink)
    return out.withColumn("cash_weight", 1 - F.col("_t") * shrink).drop("_t")


def share_targets(weighted: DataFrame, nav: Column) -> DataFrame:
    """Whole shares at the raw close; a line without a positive price is unpriced."""
    ok = F.coalesce(F.col("px") > 0, F.lit(False))
    shares = F.when(ok, F.floor(nav * F.col("weight") / F.col("px")))
    return (
        weighted.withColumn("unpriced", ~ok)
        .withColumn("target_shares", shares)
        .withColumn("achieved_weight", F.col("target_shares") * F.col("px") / nav)
    )


def rebalance_orders(targets: DataFrame, current: DataFrame, nav: Column, band: float) -> DataFrame:
    """Entries always, held lines when the gap exceeds the band, exits whenever priced.

    ``current`` carries shares and its own price for lines no longer targeted.
    """
    t = targets.where("not unpriced").select(*GROUP, "entity_id", "target_shares", "achieved_weight", "px")
    c = current.where("shares > 0").select(*GROUP, "entity_id", "shares", F.col("px").alias("_held_px"))
    j = t.join(c, [*GROUP, "entity_id"], "full_outer")
    cur = F.coalesce("shares", F.lit(0))
    price = F.coalesce("px", "_held_px")
    gap = F.abs(F.coalesce("achieved_weight", F.lit(0.0)) - cur * price / nav) * 100
    reason = first_true(
        (F.col("target_shares").isNull(), "EXIT"), (cur <= 0, "ENTRY"), (gap > band, "BAND_EXCEEDED")
    )
    out = j.select(
        *GROUP, "entity_id", (F.coalesce("target_shares", F.lit(0)) - cur).alias("delta_shares"), cur.alias("current_shares"),
        F.coalesce("target_shares", F.lit(0)).alias("target_shares"), price.alias("price"), gap.alias("gap_pct"), reason.alias("reason"),
    )
    return out.where(F.col("reason").isNotNull() & (F.col("delta_shares") != 0) & F.col("price").isNotNull())


def factor_tags(members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sorted factor tags per member; a member without any is unclassified."""
    tags = assignments.groupBy("entity_id").agg(F.array_sort(F.collect_set("factor")).alias("factors"))
    out = members.join(tags, "entity_id", "left")
    return out.withColumn("classified", F.col("factors").isNotNull()).withColumn(
        "factors", F.coalesce("factors", F.array().cast("array<string>"))
    )
