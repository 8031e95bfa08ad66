"""Order fills against bars, costs, lots, positions and net asset value as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import ratio
from knownwhen.operators.market import by_entity, carry_closes, with_index
from knownwhen.operators.scan import interval_join, month_of, running
from knownwhen.session import materialise, small, written


def _slots(bars: DataFrame, delay: int, max_bars: int, participation: float) -> DataFrame:
    """Attach to every bar the fill slots of an order decided on it, as a short array.

    Windows over a daily series; orders then need a single join. Untradable bars use up a
    slot with no capacity. Zero delay puts the decision close in front.
    """
    w = by_entity()
    tradable = F.col("tradable") if "tradable" in bars.columns else F.lit(True)
    cap = F.when(tradable, F.floor(F.col("volume") * participation)).otherwise(0).cast("bigint")
    slot = F.struct("session", F.col("open").alias("ref"), cap.alias("cap"))
    start = max(delay, 1)
    ahead = F.collect_list(slot).over(w.rowsBetween(start, start + max_bars - 1))
    if delay == 0:
        ahead = F.concat(F.array(F.struct("session", F.col("close").alias("ref"), cap.alias("cap"))), ahead)
    whole = Window.partitionBy("entity_id")
    return (
        bars.withColumn("slots", ahead)
        .withColumn("next_session", F.lead("session").over(w))
        .withColumn("bars_after", F.count(F.lit(1)).over(whole) - F.row_number().over(w))
        .select("entity_id", F.col("session").alias("anchor"), "next_session", F.col("close").alias("decision_close"), "slots", "bars_after")
    )


def _anchored(orders: DataFrame, slots: DataFrame, delay: int) -> DataFrame:
    """Each order on its entity's last bar at or before the decision; zero delay takes no older bar."""
    out = interval_join(slots, orders, ["entity_id"], "anchor", "next_session", "decided", unit="month")
    return out.where(F.col("anchor") == F.col("decided")) if delay == 0 else out


def participation_fill(orders: DataFrame, bars: DataFrame, *, delay: int = 1, max_bars: int = 5, participation: float = 0.005) -> DataFrame:
    """Allocate each order over its slots: what capacity before it left over, up to the slot's own."""
    a = _anchored(orders, _slots(bars, delay, max_bars, participation), delay)
    fill = F.transform(
        "slots",
        lambda s, i: F.struct(
            s["session"].alias("session"),
            s["ref"].alias("ref"),
            F.greatest(
                F.lit(0).cast("bigint"),
                F.least(
                    s["cap"],
                    F.col("quantity")
                    - F.aggregate(F.slice("slots", F.lit(1), i), F.lit(0).cast("bigint"), lambda x, y: x + y["cap"]),
                ),
            ).alias("filled"),
        ),
    )
    rows = a.withColumn("_f", F.explode(fill))
    cols = [c for c in orders.columns if c != "entity_id"]
    return rows.select("entity_id", *cols, "decision_close", "_f.*").where("filled > 0")


def fill_window_observed(orders: DataFrame, bars: DataFrame, *, delay: int = 1, max_bars: int = 5) -> DataFrame:
    """Whether the entity's own bars already cover the whole fill window."""
    a = _anchored(orders, _slots(bars, delay, max_bars, 0.0), delay)
    need = max(delay, 1) + max_bars - 1
    return a.select("order_id", (F.col("bars_after") >= need).alias("observed"))


def resolve_costs(orders: DataFrame, tiers: DataFrame, spreads: DataFrame, multiplier: Column) -> DataFrame:
    """Costs of an order's tier, with the symbol's half spread or the tier's default."""
    s = spreads.select("tier", F.col("entity_id").alias("_e"), "half_spread_bps")
    base = s.where(F.col("_e") == "default").select("tier", F.col("half_spread_bps").alias("_d"))
    own = s.where(F.col("_e") != "default").withColumnRenamed("tier", "_t")
    out = orders.join(tiers, "tier").join(base, "tier", "left")
    out = out.join(own, (F.col("tier") == F.col("_t")) & (F.col("entity_id") == F.col("_e")), "left")
    half = F.coalesce("half_spread_bps", "_d", F.lit(0.0)) * multiplier
    return (
        out.withColumn("half_bps", half)
        .withColumn("slip_bps", (F.col("slippage_bps") + F.col("impact_bps")) * multiplier)
        .withColumn("fee_bps", F.col("commission_bps") * multiplier)
        .drop("_d", "_t", "_e", "half_spread_bps", "slippage_bps", "impact_bps", "commission_bps")
    )


def fill_cost(fills: DataFrame, half_bps: Column, slip_bps: Column, fee_bps: Column) -> DataFrame:
    """Adverse price and fees of each fill."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    out = fills.withColumn("price", F.col("ref") * (1 + sign * (half_bps + slip_bps) / 10000))
    return out.withColumn("fees", F.col("price") * F.col("filled") * fee_bps / 10000)


def execution_shortfall(costed: DataFrame) -> DataFrame:
    """Signed cost of an order's fills against the decision close, in money and basis points."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    cost = sign * (F.col("price") - F.col("decision_close")) * F.col("filled") + F.col("fees")
    out = costed.groupBy("order_id").agg(
        F.sum("filled").alias("filled"), F.sum(cost).alias("shortfall"), F.max("decision_close").alias("_c")
    )
    bps = F.coalesce(ratio(F.col("shortfall") * 10000, F.col("_c") * F.col("filled")), F.lit(0.0))
    return out.withColumn("shortfall_bps", bps).drop("_c")


def adv_share_cap(bars: DataFrame, window: int, participation: float) -> DataFrame:
    """Whole shares an order may take: trailing mean volume (short history allowed) times participation."""
    w = by_entity().rowsBetween(1 - window, 0)
    return bars.withColumn("share_cap", F.floor(F.avg("volume").over(w) * participation))


def fills_before_decision(fills: DataFrame, delay: int) -> DataFrame:
    early = F.col("session") < F.col("decided")
    return fills.where(early | (F.col("session") == F.col("decided")) if delay > 0 else early)


def split_factor(df: DataFrame, splits: DataFrame, date: str, name: str = "split_factor") -> DataFrame:
    """Product of the entity's split ratios with ex-date at or before a date.

    Splits come as one short array per entity, so rows are joined once and never multiplied;
    the array table is broadcast if its count allows, so rows are not shuffled by entity.
    """
    s = small(splits.groupBy("entity_id").agg(F.collect_list(F.struct("effective_date", "ratio")).alias("_s")))
    out = df.join(s, "entity_id", "left")
    hit = F.filter("_s", lambda x: x["effective_date"] <= F.col(date))
    f = F.aggregate(hit, F.lit(1.0), lambda a, x: a * x["ratio"])
    return out.withColumn(name, F.coalesce(f, F.lit(1.0))).drop("_s")


def split_unit_restatement(fills: DataFrame, splits: DataFrame) -> DataFrame:
    """Fills worked in decision units restated in the units of the session they execute in."""
    splits = materialise(splits)
    out = split_factor(split_factor(fills, splits, "decided", "_f0"), splits, "session", "_f1")
    out = out.withColumn("factor", F.col("_f1") / F.col("_f0"))
    return (
        out.withColumn("session_quantity", F.col("filled") * F.col("factor"))
        .withColumn("decision_price", F.col("ref") * F.col("factor"))
        .withColumn("crossed_split", F.col("factor") != 1)
        .drop("_f0", "_f1")
    )


def gate_suppression(orders: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blocked new risk drops increases; HOLD_ONLY drops every order."""
    out = orders.join(verdicts, "decision")
    hold = F.col("halt_state") == "HOLD_ONLY"
    rise = F.col("delta_shares") > 0
    status = (
        F.when(hold & rise, "SUPPRESSED_ENTRY")
        .when(hold, "SUPPRESSED_EXIT")
        .when(~F.col("new_risk_allowed") & rise, "SUPPRESSED_ENTRY")
        .otherwise("ACTIONABLE")
    )
    return out.withColumn("status", status)


def frozen_exits(held: DataFrame, targets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Held lines the target removes while a HOLD_ONLY verdict freezes the book."""
    frozen = verdicts.where(F.col("halt_state") == "HOLD_ONLY").select("decision")
    keys = [*(["trial"] if "trial" in held.columns else []), "decision", "entity_id"]
    return held.join(frozen, "decision", "left_semi").join(targets.select(*keys), keys, "left_anti")


PAIR = ["account", "entity_id"]


def lot_match_fifo(fills: DataFrame, splits: DataFrame) -> DataFrame:
    """First-in-first-out matching of sells to buys by cumulative quantity.

    Buys and sells of an (account, entity) each cover an axis of split-adjusted shares.
    Their boundaries are merged into one sorted list; between two neighbours exactly one
    buy meets one sell. Work is linear in the fills: nothing is paired up and filtered, and a
    lot moves once, to its stretch of the axis, where both sides and the next boundary are read off.
    """
    f = split_factor(fills, splits, "session").withColumn("units", F.col("qty") / F.col("split_factor"))
    unit_cost = (F.col("price") * F.col("qty") + F.col("fee")) / F.col("units")
    unit_net = (F.col("price") * F.col("qty") - F.col("fee")) / F.col("units")
    f = f.select(*PAIR, "side", "fill_id", "session", "units", unit_cost.alias("cost"), unit_net.alias("net"))
    f = running(f, [*PAIR, "side"], ["session", "fill_id"], month_of("session"), {"until": ("sum", F.col("units"))})
    lot = F.struct("fill_id", "session", "until", "cost", "net")
    pos = F.col("until") - F.col("units")
    b = written(f.select(*PAIR, "side", pos.alias("pos"), F.floor(pos / 100000).alias("_seg"), lot.alias("lot")))
    stretch, order = [*PAIR, "_seg"], F.struct("pos", "side", "lot.fill_id")
    # What a stretch hands on: the last lot of each side to later ones, its first boundary to the one before it.
    buy, sell = (F.when(F.col("side") == k, F.col("lot")) for k in ("BUY", "SELL"))
    ends = b.groupBy(*stretch).agg(
        F.max_by("lot", F.when(F.col("side") == "BUY", order)).alias("_buy"), F.max_by("lot", F.when(F.col("side") == "SELL", order)).alias("_sell"),
        F.min("pos").alias("_first"),
    )
    axis = Window.partitionBy(*PAIR).orderBy("_seg")
    earlier = axis.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *stretch, F.last("_buy", ignorenulls=True).over(earlier).alias("_buy"), F.last("_sell", ignorenulls=True).over(earlier).alias("_sell"),
        F.lead("_first").over(axis).alias("_first"),
    )
    inside = Window.partitionBy(*stretch).orderBy("pos", "side", "lot.fill_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    m = b.select(
        *stretch, "pos", F.last(buy, ignorenulls=True).over(upto).alias("buy"), F.last(sell, ignorenulls=True).over(upto).alias("sell"),
        F.lead("pos").over(inside).alias("next_pos"),
    )
    m = m.join(ends, stretch, "left").select(
        *PAIR, "pos", F.coalesce("buy", "_buy").alias("buy"), F.coalesce("sell", "_sell").alias("sell"), F.coalesce("next_pos", "_first").alias("next_pos")
    )
    # The last boundary of a side may end before the next start: a match stops at either lot's end.
    qty = F.least(F.col("buy.until"), F.col("sell.until"), F.coalesce("next_pos", F.least("buy.until", "sell.until"))) - F.col("pos")
    m = m.where(F.col("buy").isNotNull() & F.col("sell").isNotNull()).withColumn("units", qty).where("units > 0")
    basis, proceeds = F.col("units") * F.col("buy.cost"), F.col("units") * F.col("sell.net")
    return m.select(
        *PAIR, F.col("buy.fill_id").alias("buy_id"), F.col("sell.fill_id").alias("sell_id"), F.col("buy.session").alias("opened"),
        F.col("sell.session").alias("closed"), "units", proceeds.alias("proceeds"), basis.alias("basis"), (proceeds - basis).alias("gain"),
        gain_term(F.col("buy.session"), F.col("sell.session")).alias("term"),
    )


def gain_term(opened: Column, closed: Column) -> Column:
    return F.when(F.datediff(closed, opened) > 365, "LONG_TERM").otherwise("SHORT_TERM")


def realized_summary(matches: DataFrame) -> DataFrame:
    """Short, long and total gain per account with a grand total."""
    short = F.sum(F.when(F.col("term") == "SHORT_TERM", F.col("gain")).otherwise(0.0))
    long = F.sum(F.when(F.col("term") == "LONG_TERM", F.col("gain")).otherwise(0.0))
    return matches.rollup("account").agg(short.alias("short_term"), long.alias("long_term"), F.sum("gain").alias("total"))


def _signed(side: str = "side") -> Column:
    return F.when(F.col(side) == "BUY", F.col("qty")).otherwise(-F.col("qty"))


def positions_by_session(fills: DataFrame, actions: DataFrame) -> DataFrame:
    """Quantity held after each session that changes it, in that session's units.

    Fills are summed per (account, entity, session) first, so the running window has at
    most one row per session. Splits apply before same-day fills; an ending clears the line.
    """
    day = fills.groupBy(*PAIR, "session").agg(F.sum(_signed()).alias("net"))
    splits = actions.where(F.col("kind") == "SPLIT")
    lines = day.select(*PAIR).distinct()
    change = actions.where(F.col("kind").isin("SPLIT", "DELISTING")).select(
        "entity_id", F.col("effective_date").alias("session"), F.when(F.col("kind") == "DELISTING", F.col("effective_date")).alias("_end")
    )
    marks = lines.join(change, "entity_id").withColumn("net", F.lit(0).cast("bigint"))
    ev = day.unionByName(marks, allowMissingColumns=True).groupBy(*PAIR, "session").agg(F.sum("net").alias("net"), F.max("_end").alias("_end"))
    ev = split_factor(ev, splits, "session")
    w = Window.partitionBy(*PAIR).orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    units = F.sum(F.col("net") / F.col("split_factor")).over(upto)
    gone = F.max("_end").over(upto).isNotNull()
    out = ev.withColumn("quantity", F.when(gone, 0.0).otherwise(units * F.col("split_factor")))
    return out.withColumn("next_session", F.lead("session").over(w)).select(*PAIR, "session", "quantity", "next_session")


def entitled_dividends(positions: DataFrame, dividends: DataFrame) -> DataFrame:
    """Dividend times the quantity held strictly before the ex-date, credited on the pay date."""
    d = dividends.withColumn("_eve", F.date_sub("ex_date", 1))
    hit = interval_join(positions, d, ["entity_id"], "session", "next_session", "_eve", unit="month")
    hit = hit.where("quantity <> 0")
    return hit.select(
        *PAIR, "ex_date", "pay_date", F.col("quantity").alias("entitled"), (F.col("quantity") * F.col("amount")).alias("credit")
    )


def _expand(df: DataFrame, keys: list[str], cols: list[str], sessions: DataFrame) -> DataFrame:
    """Hold each row's values over every session until the key's next row."""
    last = sessions.agg(F.max("idx")).scalar()
    x = with_index(df, sessions).withColumn("_next", F.lead("idx").over(Window.partitionBy(*keys).orderBy("idx")))
    x = x.withColumn("_until", F.coalesce(F.col("_next") - 1, last))
    return x.select(*keys, *cols, F.explode(F.sequence("idx", "_until")).alias("idx"))


def nav_by_session(positions: DataFrame, flows: DataFrame, bars: DataFrame, sessions: DataFrame, initial: float) -> DataFrame:
    """Cash plus carried closes per account and session, invested weight, lines without a price.

    Sessions are joined by their dense index; the mark is one equi-join and one partial
    aggregation over account x held line x session.
    """
    cash = flows.groupBy("account", "session").agg(F.sum("amount").alias("_a"))
    run = Window.partitionBy("account").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    cash = _expand(cash.withColumn("cash", F.sum("_a").over(run) + initial), ["account"], ["cash"], sessions)
    held = _expand(positions, PAIR, ["quantity"], sessions).where("quantity <> 0")
    px = carry_closes(bars, sessions).select("entity_id", "idx", "carried_close")
    mark = held.join(px, ["entity_id", "idx"], "left").groupBy("account", "idx").agg(
        F.sum(F.col("quantity") * F.col("carried_close")).alias("market"),
        F.count(F.lit(1)).alias("n_held"),
        F.count_if(F.col("carried_close").isNull()).alias("n_unpriced"),
    )
    out = cash.join(mark, ["account", "idx"], "left").join(F.broadcast(sessions), "idx")
    nav = F.col("cash") + F.coalesce("market", F.lit(0.0))
    out = out.withColumn("nav", F.when(F.coalesce("n_unpriced", F.lit(0)) == 0, nav))
    weight = F.when(F.col("nav") > 0, (F.col("nav") - F.col("cash")) / F.col("nav")).otherwise(0.0)
    return out.withColumn("invested", weight).withColumn("n_held", F.coalesce("n_held", F.lit(0)))


def oversell_overspend(fills: DataFrame, initial: float) -> DataFrame:
    """Fills that sell more than is held or spend more than is there, with the running balance.

    Fill-level running sums, cut by month so that a hot account is spread over tasks.
    """
    f = materialise(running(fills, PAIR, ["session", "fill_id"], month_of("session"), {"held_after": ("sum", _signed())}))
    gross = F.col("price") * F.col("qty")
    flow = F.when(F.col("side") == "BUY", -(gross + F.col("fee"))).otherwise(gross - F.col("fee"))
    f = running(f, ["account"], ["session", "fill_id"], month_of("session"), {"_cash": ("sum", flow.cast("decimal(38,6)"))})
    f = f.withColumn("cash_after", F.col("_cash") + F.lit(initial).cast("decimal(20,2)"))
    over = (F.col("side") == "SELL") & (F.col("held_after") < 0)
    broke = (F.col("side") == "BUY") & (F.col("cash_after") < 0)
    return f.where(over | broke).withColumn("issue", F.when(over, "OVERSELL").otherwise("OVERSPEND"))


def book_state_asof(nav: DataFrame) -> DataFrame:
    """High-water mark and session-start value beside each session's NAV."""
    w = Window.partitionBy("account").orderBy("session")
    return nav.withColumn("high_water", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "session_start", F.coalesce(F.lag("nav").over(w), "nav")
    )


def passive_arm(bars: DataFrame, actions: DataFrame, sessions: DataFrame, cash: float, *, delay: int = 1, adverse_bps: float = 7.0) -> DataFrame:
    """Buy each entity once at its first open after the delay and hold, dividends kept as cash."""
    actions = materialise(actions)
    b = with_index(bars, sessions)
    entry = b.where(F.col("idx") > delay).groupBy("entity_id").agg(F.min_by(F.struct("session", "idx", "open"), "session").alias("e"))
    price = F.col("e.open") * (1 + adverse_bps / 10000)
    entry = entry.select("entity_id", F.col("e.session").alias("entry"), F.col("e.idx").alias("_i0"), price.alias("entry_price"))
    entry = entry.withColumn("shares", F.floor(cash / F.col("entry_price")))
    entry = split_factor(entry, actions.where("kind = 'SPLIT'"), "entry", "_f0")
    px = carry_closes(bars, sessions).join(entry, "entity_id").where(F.col("idx") >= F.col("_i0"))
    px = split_factor(px, actions.where("kind = 'SPLIT'"), "session", "_f1")
    px = px.withColumn("quantity", F.col("shares") * F.col("_f1") / F.col("_f0"))
    paid = actions.where("kind = 'CASH_DIVIDEND'").groupBy("entity_id").agg(
        F.collect_list(F.struct(F.col("effective_date").alias("d"), F.col("amount").alias("a"))).alias("_d")
    )
    px = px.join(paid, "entity_id", "left")
    got = F.aggregate(
        F.filter("_d", lambda x: (x["d"] > F.col("entry")) & (x["d"] <= F.col("session"))), F.lit(0.0), lambda acc, x: acc + x["a"]
    )
    left = cash - F.col("shares") * F.col("entry_price")
    income = F.col("shares") * F.coalesce(got, F.lit(0.0))
    return px.select("entity_id", "session", "quantity", (left + income + F.col("quantity") * F.col("carried_close")).alias("nav"))
