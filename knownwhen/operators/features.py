"""Features per entity and decision, for all decisions in one job, from what each decision could see.

Windows run once over each entity's final series (bounded by the calendar); a decision
then picks the row of the entity's last bar by an interval join. That row is what the
decision saw unless a version of a bar or action of its history became visible only
later. Such touched (entity, decision) pairs, and no others, are worked out again on the
versions that were visible to them, about 300 rows a pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import reasons
from knownwhen.operators.market import ENDINGS, by_entity, total_return
from knownwhen.operators.pit import win_intervals
from knownwhen.operators.scan import interval_join
from knownwhen.session import materialise

SESSIONS_PER_YEAR = 252


@dataclass(frozen=True)
class FeatureParams:
    lookback: int = 252
    skip: int = 21
    sma: int = 200
    vol: int = 63
    adv: int = 20

    @property
    def required_sessions(self) -> int:
        return max(self.lookback + 1, self.sma, self.vol + 1, self.adv)

    @property
    def load_days(self) -> int:
        """Calendar days read before a decision: 8/5 per required session, rounded up, plus 30."""
        return -(-self.required_sessions * 8 // 5) + 30


def load_start(decision_session: Column, p: FeatureParams) -> Column:
    return F.date_sub(decision_session, p.load_days)


def history_requirement(decisions: DataFrame, p: FeatureParams) -> DataFrame:
    return decisions.withColumn("required_sessions", F.lit(p.required_sessions)).withColumn(
        "load_start", load_start(F.col("decision_session"), p)
    )


def momentum(level: Column, w, p: FeatureParams) -> Column:
    start = F.lag(level, p.lookback).over(w)
    return F.when(start > 0, F.lag(level, p.skip).over(w) / start - 1)


def trend(price: Column, w, n: int) -> Column:
    last = w.rowsBetween(1 - n, 0)
    return F.when(F.count(price).over(last) == n, price > F.avg(price).over(last))


def dollar_volume(price: Column, volume: Column, w, n: int) -> Column:
    last = w.rowsBetween(1 - n, 0)
    return F.when(F.count(price).over(last) == n, F.avg(price * volume).over(last))


def series(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Total-return levels and returns at every bar, without terminal points."""
    w = by_entity()
    step = F.col("tr_index") / F.nullif(F.lag("tr_index").over(w), F.lit(0.0))
    x = total_return(bars, actions, keep=["id", "close", "volume"]).where("not terminal")
    return x.select(
        "entity_id",
        "session",
        "id",
        F.col("close").alias("px"),
        "volume",
        "tr_index",
        "adj_close",
        F.lead("session").over(w).alias("next_session"),
        F.lag("session").over(w).alias("prev_session"),
        F.when(step > 0, F.ln(step)).alias("log_return"),
    )


def panel(bars: DataFrame, actions: DataFrame, p: FeatureParams) -> DataFrame:
    """Every windowed feature at every bar, with the first session each one reads."""
    w = by_entity()
    return series(bars, actions).select(
        "entity_id",
        "session",
        "id",
        "px",
        "next_session",
        "prev_session",
        "log_return",
        momentum(F.col("tr_index"), w, p).alias("mom"),
        trend(F.col("adj_close"), w, p.sma).alias("trend"),
        dollar_volume(F.col("px"), F.col("volume"), w, p.adv).alias("adv"),
        F.lag("session", p.lookback).over(w).alias("mom_from"),
        F.lag("session", p.sma - 1).over(w).alias("trend_from"),
        F.lag("session", p.adv - 1).over(w).alias("adv_from"),
        F.col("session").alias("px_from"),
    )


def last_row(own: DataFrame, p: FeatureParams) -> DataFrame:
    """The panel's columns at the last bar of each series: one aggregation by distance from the end."""
    back = F.row_number().over(by_entity().orderBy(F.col("session").desc()))
    k = F.col("_k")
    at = lambda name, n: F.max(F.when(k == n, F.col(name)))
    start = at("tr_index", p.lookback + 1)
    mean = lambda x, n: F.when(F.count(F.when(k <= n, x)) == n, F.avg(F.when(k <= n, x)))
    return own.withColumn("_k", back).groupBy("entity_id").agg(
        at("session", 1).alias("session"),
        at("px", 1).alias("px"),
        at("session", 1).alias("px_from"),
        F.when(start > 0, at("tr_index", p.skip + 1) / start - 1).alias("mom"),
        (at("adj_close", 1) > mean(F.col("adj_close"), p.sma)).alias("trend"),
        mean(F.col("px") * F.col("volume"), p.adv).alias("adv"),
        at("session", p.lookback + 1).alias("mom_from"),
        at("session", p.sma).alias("trend_from"),
        at("session", p.adv).alias("adv_from"),
    )


BAR_KEY, ACTION_KEY, PAIR = ["entity_id", "session"], ["entity_id", "kind", "effective_date"], ["decision_session", "entity_id"]


@dataclass(frozen=True)
class PitPanel:
    """Panel rows of the final series, the pairs that must not read them, those pairs' own series and last rows."""

    final: DataFrame
    touched: DataFrame
    asof: DataFrame
    asof_last: DataFrame

    def kept(self) -> PitPanel:
        """For readers of more than one part: cut from the versions once."""
        return replace(self, final=materialise(self.final))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The final version of each key."""
    rest = F.struct(*[x for x in rows.columns if x not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, "ver").alias("_r")).select(*keys, "_r.*")


def _months(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month")))


def _seen(versions: DataFrame, keys: list[str], day: str, pairs: DataFrame, kept: Column | None = None) -> DataFrame:
    """The version of each key in a pair's load window that its decision saw; ``entity_id`` becomes the pair itself.

    Entity and month are the join key. ``kept``: rows that count however old they are, few for an entity.
    """
    wins = win_intervals(versions, keys, ["ver"], F.lit(0))
    wins = wins.withColumn("_month", F.trunc(day, "month"))
    lo = F.col("_lo")
    seen = (F.col("visible_at") <= F.col("decision_at")) & (F.col("visible_to").isNull() | (F.col("visible_to") > F.col("decision_at")))
    upto = F.col(day) <= F.col("decision_session")
    cut = pairs.withColumn("_month", _months(F.col("_lo"), F.col("decision_session")))
    out = wins.join(cut, ["entity_id", "_month"]).where(seen & upto & (F.col(day) >= lo))
    if kept is not None:
        out = out.unionByName(wins.where(kept).join(pairs, "entity_id").where(seen & (F.col(day) < lo)))
    pair = F.struct(*PAIR).alias("entity_id")
    return out.select(pair, *[x for x in versions.columns if x != "entity_id"])


def pit_panel(bars: DataFrame, actions: DataFrame, decisions: DataFrame, p: FeatureParams) -> PitPanel:
    """``bars`` (entity_id, session, close, volume, id, ver, visible_at) and ``actions`` (entity_id, kind,
    effective_date, amount, ratio, ver, visible_at) hold every version; ``decisions`` decision_session, decision_at.

    The greatest ``ver`` that is visible counts. Both are read three times; a caller whose versions are
    costly materialises them.
    """
    events = bars.select("entity_id", "session", "visible_at").unionByName(actions.select("entity_id", F.col("effective_date").alias("session"), "visible_at"))
    touched = touched_by_revision(events, decisions, ["decision_session"])
    touched = materialise(touched.withColumn("_lo", load_start(F.col("decision_session"), p)))
    final = panel(newest(bars, BAR_KEY), newest(actions, ACTION_KEY), p)
    own = series(_seen(bars, BAR_KEY, "session", touched), _seen(actions, ACTION_KEY, "effective_date", touched, F.col("kind").isin(*ENDINGS)))
    own = materialise(own)
    pair = lambda df: df.select("entity_id.*", *[x for x in df.columns if x != "entity_id"])
    return PitPanel(final, touched.select(*PAIR), pair(own), pair(last_row(own, p)))


def last_bars(pan: DataFrame, decisions: DataFrame, point: str = "decision_session") -> DataFrame:
    """Each entity's last bar at every decision."""
    return interval_join(pan, decisions, [], "session", "next_session", point, unit="month")


def last_seen(pit: PitPanel, decisions: DataFrame, cols: list[str]) -> DataFrame:
    """Each entity's last bar at every decision, as the decision saw it."""
    final = last_bars(pit.final.select("entity_id", "session", "next_session", *cols), decisions.select("decision_session"))
    return final.select(*PAIR, "session", *cols).join(pit.touched, PAIR, "left_anti").unionByName(pit.asof_last.select(*PAIR, "session", *cols))


def anchor_sessions(last: DataFrame, decisions: DataFrame) -> DataFrame:
    """Newest session any member has at a decision, else the calendar session with a flag."""
    a = last.groupBy("decision_session").agg(F.max("session").alias("_a"))
    out = decisions.join(a, "decision_session", "left")
    return out.select(
        *decisions.columns,
        F.coalesce("_a", "decision_session").alias("anchor_session"),
        F.col("_a").isNotNull().alias("anchor_from_data"),
    )


def features(pit: PitPanel, decisions: DataFrame, members: DataFrame, p: FeatureParams) -> DataFrame:
    """One row per member and decision, with reasons for whatever is missing.

    A member priced before the anchor keeps every feature empty; a window reaching back
    before the load start counts as too short. The final panel is read once.
    """
    cols = [x for n in ("mom", "trend", "adv", "px") for x in (n, f"{n}_from")]
    row = members.join(last_seen(pit, decisions, cols), PAIR, "left")
    newest = F.max("session").over(Window.partitionBy("decision_session"))
    row = row.withColumn("anchor_from_data", newest.isNotNull())
    row = row.withColumn("anchor_session", F.coalesce(newest, "decision_session"))
    lo = load_start(F.col("decision_session"), p)
    has_bar = F.coalesce(F.col("session") >= lo, F.lit(False))
    at = has_bar & F.coalesce(F.col("session") == F.col("anchor_session"), F.lit(False))
    for name in ("mom", "trend", "adv", "px"):
        row = row.withColumn(name, F.when(at & (F.col(f"{name}_from") >= lo), F.col(name)))
    short = F.col("mom").isNull() | F.col("trend").isNull() | F.col("adv").isNull()
    why = reasons(
        (~has_bar, "NO_BAR_AT_DECISION"), (has_bar & ~at, "STALE_ANCHOR"), (at & short, "INSUFFICIENT_HISTORY")
    )
    return row.withColumn("reasons", why).drop(*[x for x in cols if x.endswith("_from")])


def cash_hurdle(feats: DataFrame, cash: str) -> DataFrame:
    """Momentum of the cash leg, only where it is priced at the anchor itself."""
    c = feats.where(F.col("entity_id") == cash)
    at = F.coalesce(F.col("session") == F.col("anchor_session"), F.lit(False))
    return c.select("decision_session", at.alias("cash_at_anchor"), F.when(at, F.col("mom")).alias("cash_mom"))


def eligible(feats: DataFrame) -> DataFrame:
    ok = feats.where(F.col("mom").isNotNull() & F.col("trend").isNotNull())
    return ok.select("decision_session", "entity_id", "anchor_session")


def window_rows(pit: PitPanel, members: DataFrame, p: FeatureParams, cols: list[str]) -> DataFrame:
    """Each member's bars inside its decision's load window as the decision saw them (about 300 rows each).

    Entity and month are the join key, so the window condition is only a residual. Touched
    pairs bring their own rows.
    """
    lo = load_start(F.col("decision_session"), p)
    m = members.withColumn("_lo", lo)
    rest = m.join(pit.touched, PAIR, "left_anti").withColumn("_m", _months(F.col("_lo"), F.col("anchor_session")))
    inside = (F.col("session") <= F.col("anchor_session")) & (F.col("session") >= F.col("_lo"))
    r = pit.final.select("entity_id", "session", "prev_session", *cols, F.trunc("session", "month").alias("_m"))
    hit = rest.join(r, ["entity_id", "_m"]).where(inside).drop("_m")
    own = m.join(pit.asof.select(*PAIR, "session", "prev_session", *cols), PAIR).where(inside)
    return hit.unionByName(own)


def aligned_returns(pit: PitPanel, members: DataFrame, p: FeatureParams) -> DataFrame:
    """Returns on the last V sessions on which every eligible member of a decision has one.

    Decisions with fewer than V such sessions have no window. Members are counted by session
    before they are shuffled; only a decision's some 300 counts are ranked, and the last V
    sessions pick their rows.
    """
    by = Window.partitionBy("decision_session")
    n = members.groupBy("decision_session").agg(F.count(F.lit(1)).alias("n_members"))
    m = members.join(n, "decision_session").select("decision_session", "entity_id", "anchor_session", "n_members")
    r = window_rows(pit, m, p, ["log_return"])
    r = r.where(F.col("log_return").isNotNull() & (F.col("prev_session") >= F.col("_lo")))
    days = r.groupBy("decision_session", "session").agg(F.count(F.lit(1)).alias("_have"), F.first("n_members").alias("_all"))
    place = F.row_number().over(by.orderBy(F.col("session").desc()))
    top = days.where(F.col("_have") == F.col("_all")).withColumn("_place", place).where(F.col("_place") <= p.vol)
    top = top.withColumn("_depth", F.max("_place").over(by)).where(F.col("_depth") == p.vol).select("decision_session", "session")
    return r.join(top, ["decision_session", "session"]).select("decision_session", "session", "entity_id", "log_return", "n_members")


def common_window(aligned: DataFrame) -> DataFrame:
    return aligned.select("decision_session", "session", "n_members").distinct()


def covariance_matrix(aligned: DataFrame) -> DataFrame:
    """Annualised sample covariance; the entity pairs of a decision are the result itself.

    Both triangles come from one pass over the upper one, summed map-side first.
    """
    a = aligned.select("decision_session", "session", F.col("entity_id").alias("a"), F.col("log_return").alias("_x"))
    b = aligned.select("decision_session", "session", F.col("entity_id").alias("b"), F.col("log_return").alias("_y"))
    half = a.join(b, ["decision_session", "session"]).where(F.col("a") <= F.col("b"))
    cov = half.groupBy("decision_session", "a", "b").agg((F.covar_samp("_x", "_y") * SESSIONS_PER_YEAR).alias("cov"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    return cov.select("decision_session", F.explode(both).alias("p"), "cov").select("decision_session", "p.*", "cov")


def annualised_vol(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("decision_session", "entity_id").agg(
        F.sqrt(F.var_samp("log_return") * SESSIONS_PER_YEAR).alias("vol")
    )


def portfolio_vol(weighted: DataFrame) -> DataFrame:
    """Ex-ante portfolio volatility: the variance of the weighted return equals w' cov w.

    ``weighted`` is the aligned returns with a ``weight``. Two aggregations, linear in the
    rows; no matrix is formed.
    """
    day = weighted.groupBy("decision_session", "session").agg(F.sum(F.col("weight") * F.col("log_return")).alias("_r"))
    var = F.var_samp("_r") * SESSIONS_PER_YEAR
    return day.groupBy("decision_session").agg(F.sqrt(F.greatest(var, F.lit(0.0))).alias("portfolio_vol"))


def feature_lineage(pit: PitPanel, members: DataFrame, p: FeatureParams) -> DataFrame:
    """Observation ids each decision's features were read from, per member."""
    hit = window_rows(pit, members.select("decision_session", "entity_id", "anchor_session"), p, ["id"])
    return hit.groupBy("decision_session", "entity_id").agg(F.collect_set("id").alias("observation_ids"))


def touched_by_revision(rows: DataFrame, decisions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, decision) pairs whose series changed after the decision.

    ``rows`` carries ``session`` and ``visible_at`` per version. A row about a session at or
    before the decision that became visible only later makes the final series differ from
    what the decision saw; only these pairs need the as-of route.
    """
    late = rows.select("entity_id", F.col("session").cast("timestamp_ntz").alias("_from"), F.col("visible_at").alias("_to"))
    hit = interval_join(late, decisions, [], "_from", "_to", "decision_at", unit="month")
    return hit.select("entity_id", "decision_at", *carry).distinct()
