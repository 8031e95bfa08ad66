"""Compliance, look-through, risk and order limits, halt state, gates and decision records."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import first_true, reasons, sha256_text

# Fault states in rising order of restriction.
STATES = ("NORMAL", "HALT_NEW_RISK", "HOLD_ONLY", "EMERGENCY_FLATTEN_AUTHORIZED")


def rank_of(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state) - 1


def state_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (rank + 1).cast("int"))


# ---- compliance ------------------------------------------------------------------------


def compliance_screen(
    candidates: DataFrame,
    restricted: DataFrame,
    *,
    themes: Sequence[str],
    blackouts: Sequence[tuple[str, str]],
    list_as_of: str,
    max_age_days: int,
    key: str = "candidate",
) -> DataFrame:
    """Reasons against new risk; reductions are always clear.

    ``restricted`` lists (item, rule, until): name and etf entries, and cooling removals with
    the later of the stored date and request plus cooling days. Any alias of a candidate
    matches, in one equi-join on the exploded aliases.
    """
    new = candidates.where("is_new_risk")
    alias = new.select(key, F.col("now").alias("_now"), F.explode(F.array_distinct("identifiers")).alias("item"))
    hit = alias.join(restricted, "item").groupBy(key).agg(
        F.max(F.col("rule") == "NAME").alias("_name"),
        F.max(F.col("rule") == "ETF").alias("_etf"),
        F.max((F.col("rule") == "COOLING") & (F.col("_now") < F.col("until"))).alias("_cool"),
    )
    day = F.col("now").cast("date")
    dark = F.lit(False)
    for lo, hi in blackouts:
        dark = dark | day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    listed = F.array(*[F.lit(x) for x in themes]) if themes else F.array().cast("array<string>")
    x = new.join(hit, key, "left")

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    why = reasons(
        (F.datediff(day, F.lit(list_as_of).cast("date")) > max_age_days, "RESTRICTED_LIST_STALE"),
        (yes("_name"), "RESTRICTED_NAME"),
        (yes("_etf"), "RESTRICTED_ETF"),
        (yes("_cool"), "RESTRICTED_COOLING"),
        (F.col("theme_exposures").isNull(), "UNKNOWN_LOOK_THROUGH"),
        (F.coalesce(F.arrays_overlap("theme_exposures", listed), F.lit(False)), "RESTRICTED_THEME"),
        (dark, "BLACKOUT"),
    )
    return x.withColumn("violations", why).drop("_name", "_etf", "_cool")


def theme_match(lines: DataFrame, by_symbol: DataFrame, by_entity: DataFrame) -> DataFrame:
    """Themes of each holding line: union of its symbol's and its entity's, symbols trimmed and upper-cased."""
    s = by_symbol.select(F.upper(F.trim("symbol")).alias("_s"), "theme").distinct()
    e = by_entity.select(F.col("entity_id").alias("_e"), "theme").distinct()
    one = lines.join(s, F.upper(F.trim(lines["symbol"])) == F.col("_s")).select("fund", "line", "theme")
    two = lines.join(e, lines["entity_id"] == F.col("_e")).select("fund", "line", "theme")
    return one.unionByName(two).distinct()


def look_through(lines: DataFrame, themed: DataFrame, funds: DataFrame, *, restricted: Sequence[str], decision: Column, max_age_days: int, threshold: float) -> DataFrame:
    """Restricted weight of each fund, every line counted once; null where holdings cannot be trusted."""
    bad = themed.where(F.col("theme").isin(list(restricted)))
    per = bad.groupBy("fund", "line").agg(F.collect_set("theme").alias("_t"))
    w = lines.select("fund", "line", "weight").join(per, ["fund", "line"], "left")
    out = w.groupBy("fund").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("_t").isNotNull(), F.col("weight")).otherwise(0.0)).alias("_w"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_t")))).alias("_themes"),
    )
    out = funds.join(out, "fund", "left")
    age = F.datediff(decision, F.col("as_of"))
    known = F.col("n_lines").isNotNull() & (age >= 0) & (age <= max_age_days)
    ok = F.col("_w") <= threshold
    exposures = F.when(known, F.when(ok, F.array().cast("array<string>")).otherwise(F.col("_themes")))
    return (
        out.withColumn("theme_weight", F.when(known, F.col("_w")))
        .withColumn("admissible", F.when(known, ok))
        .withColumn("theme_exposures", exposures)
        .drop("_w", "_themes")
    )


def theme_coverage(funds: DataFrame, membership: DataFrame, restricted: DataFrame, scope: DataFrame) -> DataFrame:
    """What a fund's look-through may rely on.

    Outside the declared scope, or with nothing restricted, exposure is known to be empty. A
    restricted theme without any member leaves funds in scope unknown.
    """
    n = restricted.agg(F.count(F.lit(1))).scalar()
    gap = restricted.join(membership.select("theme").distinct(), "theme", "left_anti").agg(F.count(F.lit(1))).scalar()
    x = funds.join(scope.select("fund", F.lit(True).alias("_in")), "fund", "left")
    status = first_true((F.col("_in").isNull() | (n == 0), "EMPTY"), (gap > 0, "UNKNOWN"), default=F.lit("EVALUATE"))
    return x.withColumn("status", status).drop("_in")


# ---- risk ------------------------------------------------------------------------------


def _violations(df: DataFrame, keys: Sequence[str], subject: Column, *cases: tuple[Column, str]) -> DataFrame:
    out = df.withColumn("code", F.explode(reasons(*cases)))
    return out.select(*keys, "code", subject.cast("string").alias("subject"))


def risk_limits(
    lines: DataFrame, books: DataFrame, admitted: DataFrame, sectors: DataFrame, clusters: DataFrame, *,
    max_line: float, max_positions: int, max_gross: float, max_net: float, min_cash: float, max_sector: float, max_cluster: float,
    keys: Sequence[str] = ("trial", "decision"),
) -> DataFrame:
    """Every limit a target book breaks, as a long table of (book, code, subject).

    Weights are summed as decimals: a sum that lies exactly on a limit must not depend on
    the order of its terms.
    """
    k = list(keys)
    lines = lines.withColumn("weight", F.col("weight").cast("decimal(20,12)"))
    held = lines.where("weight > 0")
    parts = [
        _violations(lines, k, F.col("entity_id"), (F.col("weight") < 0, "NEGATIVE_WEIGHT"), (F.col("weight") > max_line, "SINGLE_LINE_WEIGHT"))
    ]
    g = held.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_g")).join(books, k, "right")
    gross = F.coalesce("_g", F.lit(0.0))
    parts.append(
        _violations(
            g, k, F.lit("*"), (F.coalesce("_n", F.lit(0)) > max_positions, "MAX_OPEN_POSITIONS"), (gross > max_gross, "GROSS_EXPOSURE"),
            (gross > max_net, "NET_EXPOSURE"), (F.col("cash_weight") < min_cash, "MIN_CASH"),
        )
    )
    ok = admitted.select("entity_id", F.lit(True).alias("_ok"))
    named = sectors.select("entity_id").distinct().withColumn("_named", F.lit(True))
    h = held.join(ok, "entity_id", "left").join(named, "entity_id", "left")
    parts.append(
        _violations(
            h, k, F.col("entity_id"), (F.col("_ok").isNull(), "NOT_ADMITTED"), (F.col("_ok") & F.col("_named").isNull(), "UNCLASSIFIED_HOLDING")
        )
    )
    sec = h.where("_ok and _named").join(sectors, "entity_id").groupBy(*k, "sector").agg(F.sum("weight").alias("_w"))
    parts.append(_violations(sec, k, F.col("sector"), (F.col("_w") > max_sector, "SECTOR_CONCENTRATION")))
    cl = held.join(clusters, "entity_id").groupBy(*k, "cluster_id").agg(
        F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"), F.max("max_members").alias("_m")
    )
    parts.append(_violations(cl, k, F.col("cluster_id"), (F.col("_w") > max_cluster, "CLUSTER_WEIGHT"), (F.col("_n") > F.col("_m"), "CLUSTER_MEMBERS")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def liquidity_reasons(adv: Column, price: Column, min_adv: float, min_price: float) -> list[tuple[Column, str]]:
    known = F.coalesce((adv > 0) & (price > 0), F.lit(False))
    return [(~known, "LIQUIDITY_UNKNOWN"), (known & (adv < min_adv), "MIN_ADV"), (known & (price < min_price), "MIN_PRICE")]


def liquidity_limits(lines: DataFrame, min_adv: float, min_price: float, keys: Sequence[str] = ("trial", "decision")) -> DataFrame:
    """Lines that increase but trade too little, too low, or unknown."""
    up = lines.where(F.col("weight") > F.coalesce(F.col("current_weight"), F.lit(0.0)))
    return _violations(up, list(keys), F.col("entity_id"), *liquidity_reasons(F.col("adv"), F.col("px"), min_adv, min_price))


def valid_quote() -> Column:
    return F.coalesce((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")), F.lit(False))


def order_limits(
    orders: DataFrame, held: DataFrame, *, max_qty: int, max_notional: float, participation: float, max_spread_bps: float, min_adv: float,
    min_price: float, max_orders: int, max_new: int, max_turnover: float, keys: Sequence[str] = ("account", "session"),
) -> DataFrame:
    """Row-level and session-level violations of an order session.

    A sell is priced at the higher of its limit and the bid. ``held`` is per line and any of
    the session keys it carries. Rows are judged in place;
    totals are partial aggregations per session and per sold line.
    """
    k = list(keys)
    sell = F.col("side") == "SELL"
    mid = (F.col("bid") + F.col("ask")) / 2
    size_px = F.when(sell & valid_quote(), F.greatest("price", "bid")).otherwise(F.col("price"))
    x = orders.withColumn("_notional", F.when(F.col("price") > 0, F.abs("qty") * size_px))
    adv_ok = F.coalesce(F.col("adv") > 0, F.lit(False))
    quoted = F.col("bid").isNotNull()
    bad_qty = ~(F.col("qty") > 0) | (F.col("qty") != F.floor("qty"))
    spread = (F.col("ask") - F.col("bid")) / mid * 10000
    rows = _violations(
        x, k, F.col("order_id"),
        (bad_qty, "BAD_QUANTITY"),
        (~bad_qty & (F.col("qty") > max_qty), "QTY_CAP"),
        (~(F.col("price") > 0), "BAD_PRICE"),
        (F.col("_notional") > max_notional, "NOTIONAL_CAP"),
        (F.col("_notional").isNotNull() & ~adv_ok & ~sell, "ADV_UNKNOWN"),
        (F.col("_notional").isNotNull() & adv_ok & (F.col("_notional") > participation * F.col("adv")), "ADV_PARTICIPATION"),
        (~sell & adv_ok & valid_quote() & (F.col("adv") < min_adv), "MIN_ADV"),
        (~sell & adv_ok & valid_quote() & (mid < min_price), "MIN_PRICE"),
        (~sell & ~quoted, "SPREAD_UNOBSERVED"),
        (~sell & quoted & ~valid_quote(), "BAD_QUOTE"),
        (~sell & valid_quote() & (spread > max_spread_bps), "SPREAD"),
    )
    by = [c for c in k if c in held.columns]
    have = held.select(*by, "entity_id", F.col("held").alias("_held"))
    line = x.groupBy(*k, "entity_id").agg(
        F.sum(F.when(sell, F.abs("qty")).otherwise(0)).alias("_sold"), F.max((~sell).cast("int")).alias("_buys")
    )
    line = line.join(have, [*by, "entity_id"], "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    over = _violations(line, k, F.col("entity_id"), (F.col("_sold") > F.col("_held"), "SELL_EXCEEDS_HELD"))
    new = line.groupBy(*k).agg(F.count_if((F.col("_buys") == 1) & (F.col("_held") <= 0)).alias("_new"))
    tot = x.groupBy(*k).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_notional").alias("_t"), F.max("nav").alias("_nav"), F.max((~sell).cast("int")).alias("_buy")
    )
    tot = tot.join(new, k)
    total = _violations(
        tot, k, F.lit("*"),
        (F.col("_n") > max_orders, "MAX_ORDERS_PER_SESSION"),
        (F.col("_new") > max_new, "MAX_NEW_POSITIONS"),
        (~(F.col("_nav") > 0) & (F.col("_buy") == 1), "BAD_NAV"),
        ((F.col("_nav") > 0) & (F.col("_t") / F.nullif("_nav", F.lit(0.0)) > max_turnover), "DAILY_TURNOVER"),
    )
    return rows.unionByName(over).unionByName(total)


def hard_caps(
    intents: DataFrame, *, account: str, sides: Sequence[str], types: Sequence[str], tifs: Sequence[str], max_qty: float, max_notional: float, max_quote_age_s: int
) -> DataFrame:
    """Second, independent check of each order intent, row by row."""
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("quote_at").cast("timestamp"))
    limit, market = F.col("order_type") == "LIMIT", F.col("order_type") != "LIMIT"
    px = (
        F.when(limit & (F.col("side") == "SELL"), F.when(F.col("limit_price").isNotNull(), F.greatest("limit_price", "bid")))
        .when(limit, F.col("limit_price"))
        .when(market & (F.col("side") == "BUY"), F.col("ask"))
        .otherwise(F.col("bid"))
    )
    why = reasons(
        (F.col("account_id") != account, "ACCOUNT_MISMATCH"),
        (F.col("mode").startswith("LIVE"), "LIVE_UNAVAILABLE"),
        (~F.col("side").isin(list(sides)), "SIDE"),
        (~F.col("order_type").isin(list(types)), "ORDER_TYPE"),
        (~F.col("tif").isin(list(tifs)), "TIF"),
        (F.coalesce("extended_hours", F.lit(False)), "EXTENDED_HOURS"),
        (~(F.col("qty") > 0), "BAD_QTY"),
        (F.col("qty") != F.floor("qty"), "FRACTIONAL"),
        (F.col("qty") > max_qty, "QTY_CAP"),
        (F.coalesce(~(px > 0), F.lit(True)), "BAD_LIMIT"),
        (F.coalesce((age < 0) | (age > max_quote_age_s * 1000000), F.lit(True)), "STALE_QUOTE"),
        ((px > 0) & (F.col("qty") * px > max_notional), "NOTIONAL_CAP"),
    )
    return intents.withColumn("reason_codes", why)


# ---- halt state ------------------------------------------------------------------------


def halt_faults(x: DataFrame, *, hold_drawdown: float, halt_drawdown: float, daily_loss: float) -> DataFrame:
    """Active faults of each (arm, decision) row and the state they demand."""
    none = F.col("nav").isNull()
    dd = (F.col("high_water") - F.col("nav")) / F.nullif("high_water", F.lit(0.0))
    loss = (F.col("session_start") - F.col("nav")) / F.nullif("session_start", F.lit(0.0))
    hwm_ok, start_ok = F.coalesce(F.col("high_water") > 0, F.lit(False)), F.coalesce(F.col("session_start") > 0, F.lit(False))
    cases = [
        (none, "UNKNOWN_STATE", 1),
        (~none & ~hwm_ok, "UNKNOWN_HIGH_WATER_MARK", 1),
        (~none & hwm_ok & (dd >= hold_drawdown), "DRAWDOWN_HOLD_ONLY", 2),
        (~none & hwm_ok & (dd >= halt_drawdown) & (dd < hold_drawdown), "DRAWDOWN_HALT_NEW_RISK", 1),
        (~none & ~start_ok, "UNKNOWN_SESSION_START_NAV", 1),
        (~none & start_ok & (loss >= daily_loss), "DAILY_LOSS_HALT", 1),
        (F.col("n_stale") > 0, "STALE_INPUT", 1),
        (F.coalesce("broker_unknown", F.lit(False)), "UNKNOWN_BROKER_STATE", 2),
        (F.coalesce("unreconciled", F.lit(False)), "RECONCILIATION_UNRESOLVED", 2),
        (F.coalesce("order_uncertain", F.lit(False)), "UNCERTAIN_ORDER_STATE", 2),
        (F.coalesce("disagree", F.lit(False)), "CORE_GATEWAY_DISAGREE", 2),
        (F.coalesce("authorization_expired", F.lit(False)), "AUTHORIZATION_EXPIRED", 1),
        (F.coalesce("version_change", F.lit(False)), "UNAPPROVED_VERSION_CHANGE", 1),
        (F.col("n_critical") > 0, "SEVERE_INCIDENT", 2),
        ((F.col("n_critical") == 0) & (F.col("n_high") > 0), "SEVERE_INCIDENT", 1),
    ]
    out = x.withColumn("faults", reasons(*[(c, n) for c, n, _ in cases]))
    floor = F.greatest(F.lit(0), *[F.when(c, F.lit(r)).otherwise(0) for c, _, r in cases])
    return out.withColumn("floor_rank", floor).withColumn("demanded", state_of(F.col("floor_rank")))


def _fold_states(keys: list[str], order: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """States of one arm in order: escalate at once, relax one step per re-arm, never below the faults."""
    pdf = pdf.sort_values(order)
    rank, out = 0, []
    for floor, to in zip(pdf["floor_rank"], pdf["rearm_to"], strict=True):
        nxt = max(rank, floor) if pd.isna(to) else max(floor, int(to), rank - 1)
        out.append((rank, nxt))
        rank = nxt
    res = pdf[[*keys, order]].copy()
    res["from_rank"], res["rank"] = [x[0] for x in out], [x[1] for x in out]
    return res


def halt_state_scan(x: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """State after each decision of an arm.

    The next state needs the last one: one ordered fold per arm, over one small row per
    decision. Faults are reduced to a rank in Spark before the fold.
    """
    kinds, k = dict(x.dtypes), list(keys)
    rows = x.select(*k, order, F.col("floor_rank").cast("int").alias("floor_rank"), F.col("rearm_to").cast("double").alias("rearm_to"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*k, order]) + ", from_rank int, rank int"
    out = rows.groupBy(*k).applyInPandas(lambda pdf: _fold_states(k, order, pdf), schema)
    return out.withColumn("state", state_of(F.col("rank")))


def break_occurrences(reconciles: DataFrame, breaks: DataFrame, acks: DataFrame, decision: Column, key: str = "arm") -> DataFrame:
    """Current unbroken run of each reported break, by gaps and islands.

    ``reconciles`` is (arm, session), one row per arm and session; ``breaks`` adds the code.
    Acknowledged only if acknowledged at or after the run's first report.
    """
    w = Window.partitionBy(key).orderBy("session")
    r = reconciles.withColumn("_seq", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    b = breaks.distinct().join(r, [key, "session"])
    b = b.withColumn("_run", F.col("_seq") - F.row_number().over(Window.partitionBy(key, "code").orderBy("_seq")))
    run = b.groupBy(key, "code", "_run").agg(
        F.min("session").alias("first_report"), F.max("_seq").alias("_end"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("length")
    )
    now = run.where(F.col("_end") == F.col("_n"))
    a = acks.groupBy(key, "code").agg(F.max("acked").alias("_acked"))
    out = now.join(a, [key, "code"], "left")
    status = first_true(
        (F.coalesce(F.col("_acked") >= F.col("first_report"), F.lit(False)), "ACKNOWLEDGED"),
        (F.col("first_report") < decision, "UNRESOLVED"),
        default=F.lit("FRESH"),
    )
    return out.withColumn("status", status).drop("_run", "_end", "_n", "_acked")


def decision_gate(lines: DataFrame, books: DataFrame, evaluated: DataFrame, violations: DataFrame, keys: Sequence[str] = ("trial", "decision")) -> DataFrame:
    """Whether a book may take new risk: halt, limits, compliance and coverage all clear.

    ``violations`` is any union of limit tables. A line whose target rises must have been
    evaluated under its own key; a line that was not blocks the book.
    """
    k = list(keys)
    up = lines.where(F.col("weight") > F.coalesce(F.col("current_weight"), F.lit(0.0)))
    done = evaluated.groupBy(*k, "entity_id").agg(F.min("admitted").alias("_ok"))
    miss = up.join(done, [*k, "entity_id"], "left_anti").groupBy(*k).agg(F.count(F.lit(1)).alias("uncovered"))
    comp = done.groupBy(*k).agg(F.count_if(~F.col("_ok")).alias("not_admitted"))
    bad = violations.groupBy(*k).agg(F.count(F.lit(1)).alias("n_violations"))
    rise = up.groupBy(*k).agg(F.count(F.lit(1)).alias("increased"))
    out = books
    for t in (rise, miss, comp, bad):
        out = out.join(t, k, "left")
    out = out.na.fill(0, ["increased", "uncovered", "not_admitted", "n_violations"])
    ok = (F.col("halt_state") == "NORMAL") & (F.col("n_violations") == 0) & (F.col("not_admitted") == 0) & (F.col("uncovered") == 0)
    why = reasons(
        (F.col("halt_state") != "NORMAL", "HALT"), (F.col("n_violations") > 0, "LIMIT"), (F.col("not_admitted") > 0, "COMPLIANCE"),
        (F.col("uncovered") > 0, "MISSING_COMPLIANCE"),
    )
    return out.withColumn("new_risk_allowed", ok).withColumn("blocked_by", why)


def stale_market(anchors: DataFrame) -> DataFrame:
    """Faults when every feed is behind, none has data, or the cash leg is behind the anchor."""
    fault = first_true(
        (~F.col("anchor_from_data"), "NO_MARKET_DATA"), (F.col("anchor_session") < F.col("decision_session"), "ALL_FEEDS_BEHIND")
    )
    cash = F.col("anchor_from_data") & ~F.coalesce("cash_at_anchor", F.lit(False))
    out = anchors.withColumn("faults", F.array_compact(F.array(fault, F.when(cash, F.lit("CASH_LEG_BEHIND")))))
    return out.where(F.size("faults") > 0)


# ---- records ---------------------------------------------------------------------------


def seal_records(rows: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Content hash of each decision row over its fields in sorted order, and whether its key repeats."""
    doc = F.to_json(F.struct(*[F.col(x) for x in sorted(fields)]))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.withColumn("seal", sha256_text(doc)).join(n, list(keys))
    return out.withColumn("duplicate_key", F.col("_n") > 1).drop("_n")


def missing_records(
    sealed: DataFrame, weekly: DataFrame, arms: DataFrame, fills: DataFrame, unfilled: DataFrame, cash: DataFrame, through: Column
) -> DataFrame:
    """Breaks of the decision ledger: decisions and fills that are owed, remainders, negative cash.

    Expected decisions run from the first one any arm sealed. ``sealed`` carries the session
    a fill is owed by.
    """
    start = sealed.agg(F.min("session")).scalar()
    due = weekly.where((F.col("session") >= start) & (F.col("session") <= through))
    names = arms.agg(F.collect_set("arm")).scalar()
    grid = due.withColumn("arm", F.explode(names))

    def tag(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "arm", "session")

    one = grid.join(sealed.select("arm", "session"), ["arm", "session"], "left_anti")
    two = sealed.where(F.col("owed_by") <= through).join(fills.select("arm", "session"), ["arm", "session"], "left_anti")
    three = unfilled.where(F.col("reason") != "CASH").select("arm", "session").distinct()
    four = cash.where(F.col("cash") < 0)
    return (
        tag(one, "MISSING_DECISION_RECORD")
        .unionByName(tag(two, "MISSING_FILL_RECORD"))
        .unionByName(tag(three, "UNFILLED_REMAINDER"))
        .unionByName(tag(four, "NEGATIVE_CASH"))
    )


def overlay_arms(base: DataFrame, assessments: DataFrame, *, replay: bool) -> DataFrame:
    """The veto arm (base minus net-negative) and the stand-alone arm (net-positive only).

    A missing or abstaining assessment keeps a base line and never selects a new one.
    """
    a = assessments.where("not abstain").select(
        "candidate", (F.size("evidence_for") > 0).alias("_for"), (F.size("evidence_against") > 0).alias("_against")
    )
    veto = base.join(a, "candidate", "left").where(~F.coalesce(F.col("_against") & ~F.col("_for"), F.lit(False)))
    alone = a.where(F.col("_for") & ~F.col("_against"))
    label = F.lit("HISTORICAL_REPLAY_CONTAMINATED" if replay else None).cast("string")
    return (
        veto.select(F.lit("C1").alias("arm"), "candidate").unionByName(alone.select(F.lit("D1").alias("arm"), "candidate")).withColumn("label", label)
    )


def assessment_checks(assessments: DataFrame, packets: DataFrame) -> DataFrame:
    """First reason an assessment is rejected, or null; citations must be in its sealed packet.

    ``packets`` is (candidate, source) with one row per citable source.
    """
    cited = assessments.select("candidate", F.explode(F.array_union("evidence_for", "evidence_against")).alias("source"))
    loose = cited.join(packets.select("candidate", "source"), ["candidate", "source"], "left_anti")
    bad = loose.groupBy("candidate").agg(F.count(F.lit(1)).alias("_loose"))
    x = assessments.join(bad, "candidate", "left")
    same = F.array_sort(F.array_distinct("factors_touched")) == F.array_sort(F.array_distinct("factors"))
    code = first_true(
        (F.col("abstain") & F.col("abstain_reason").isNull(), "MISSING_ABSTAIN_REASON"),
        (~F.col("abstain") & (F.trim("thesis") == ""), "EMPTY_THESIS"),
        (~F.col("abstain") & F.col("_loose").isNotNull(), "CITATION_UNRESOLVED"),
        (~F.col("abstain") & ~same, "FACTOR_MISMATCH"),
    )
    return x.withColumn("rejection", code).withColumn("n_unresolved", F.coalesce("_loose", F.lit(0))).drop("_loose")


def evidence_packets(facts: DataFrame, keys: Sequence[str] = ("decision_at", "entity_id")) -> DataFrame:
    """Facts a decision saw about one candidate, ordered and hashed with their content.

    Facts are the collapsed as-of rows, one per source and effective time; a packet's size is the
    length of the history that ``facts`` holds, so give it the look-back a packet may have. The hash
    covers locator, availability, the raw content's hash and the value of every fact.
    """
    available = F.date_format(F.col("available_at").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("available")
    one = F.struct(
        "source_id", F.date_format("effective_at", "yyyy-MM-dd").alias("effective"), "id", "source_locator", available,
        "raw_content_hash", F.col("value").cast("string").alias("value"),
    )
    out = facts.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("facts"))
    text = F.array_join(
        F.transform(
            "facts",
            lambda f: F.concat_ws(
                "|", f["source_id"], f["effective"], f["id"].cast("string"), f["source_locator"], f["available"], f["raw_content_hash"], f["value"]
            ),
        ),
        ";",
    )
    return out.withColumn("packet_hash", sha256_text(text))


# Patterns that must not leave in a packet.
CURRENCY_TOTAL = r"\$\s?\d{1,3}(,\d{3})+(\.\d+)?"
SECRETS = {
    "API_KEY": r"(?i)sk-[a-z0-9]",
    "BEARER": r"(?i)bearer\s+[a-z0-9._-]+",
    "ACCESS_KEY_ID": r"\bAKIA[0-9A-Z]{16}\b",
    "PRIVATE_KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def redaction_scan(texts: DataFrame, column: str = "text", extra: dict[str, str] | None = None, excerpt: Column | None = None) -> DataFrame:
    """Currency totals and secrets found anywhere in the whole text.

    Where ``excerpt`` holds the text is quoted from a source, which may name amounts: only the
    currency rule leaves it out. One alternation of all patterns decides first; the single ones
    run only on its hits.
    """
    t = F.col(column)
    rules = {"CURRENCY_TOTAL": CURRENCY_TOTAL, **SECRETS, **(extra or {})}
    found = {n: t.rlike(p) for n, p in rules.items()}
    if excerpt is not None:
        found["CURRENCY_TOTAL"] &= ~F.coalesce(excerpt, F.lit(False))
    some = t.rlike("|".join(f"(?:{p})" for p in rules.values()))
    return texts.withColumn("findings", F.when(some, reasons(*[(x, n) for n, x in found.items()])).otherwise(F.array().cast("array<string>")))


def call_spend(calls: DataFrame) -> DataFrame:
    """Cost by UTC day, with the month's running total beside it."""
    day = calls.groupBy(F.col("at").cast("date").alias("day")).agg(F.sum("cost").alias("day_cost"), F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy(F.trunc("day", "month"))
    return day.withColumn("month_cost", F.sum("day_cost").over(w))
