"""Market series: bars as of a decision, gaps, split adjustment, total return, returns.

After the newest row per (entity, session) is chosen a series has at most one row per
trading day, so windows per entity are bounded by the calendar (about 25,000 rows a
century); everything before that point is a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import ratio
from knownwhen.operators.pit import win_intervals
from knownwhen.operators.scan import asof_join, interval_join, month_of
from knownwhen.session import materialise

ENDINGS = ("DELISTING", "MERGER")


def by_entity(entity: str = "entity_id", order: str = "session"):
    return Window.partitionBy(entity).orderBy(order)


def load_bars(rows: DataFrame, decisions: DataFrame, stale: DataFrame, unit: str = "month") -> DataFrame:
    """Bars each decision sees: newest visible row per session, tradable unless flagged or stale.

    ``rows`` carries ``visible_at`` and ``id``; ``stale`` lists (entity, session) actions.
    """
    wins = win_intervals(rows, ["entity_id", "session"], ["id"], F.floor(F.col("id") / 1048576))
    marks = stale.select("entity_id", "session").distinct().withColumn("_stale", F.lit(True))
    flagged = F.array_contains("quality_flags", F.lit("STALE_BAR")) | F.col("_stale").isNotNull()
    wins = wins.join(marks, ["entity_id", "session"], "left").withColumn("tradable", ~flagged).drop("_stale")
    return interval_join(wins, decisions, [], "visible_at", "visible_to", "decision_at", unit=unit)


def with_index(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach the dense session index; the session list has one row per trading day."""
    return df.join(F.broadcast(sessions.select("session", "idx")), "session")


def bar_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per gap: the bar that ends it and the number of sessions missing before it."""
    prev = F.lag("idx").over(by_entity())
    b = with_index(bars, sessions).withColumn("_prev", prev)
    return b.where(F.col("idx") - F.col("_prev") > 1).select(
        "entity_id",
        F.col("session").alias("gap_flag_session"),
        (F.col("_prev") + 1).alias("first_missing"),
        (F.col("idx") - 1).alias("last_missing"),
        (F.col("idx") - F.col("_prev") - 1).alias("n_missing"),
    )


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session inside an entity's span without a bar."""
    gaps = bar_gaps(bars, sessions)
    idx = gaps.select("entity_id", F.explode(F.sequence("first_missing", "last_missing")).alias("idx"))
    return idx.join(F.broadcast(sessions), "idx").select("entity_id", "session")


def dedupe_actions(rows: DataFrame) -> DataFrame:
    """One action per (entity, kind, date): reconciled before single-source, then the later id.

    Labels accumulate over all rows, so dropping a row never hides its label.
    """
    single = F.array_contains("quality_flags", F.lit("UNVERIFIED_SINGLE_SOURCE"))
    rank = F.struct((~single).alias("verified"), F.col("id"))
    keys = ["entity_id", "kind", "effective_date"]
    rest = F.struct(*[x for x in rows.columns if x not in (*keys, "quality_flags")])
    best = rows.groupBy(*keys).agg(
        F.max_by(rest, rank).alias("_r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))).alias("labels")
    )
    return best.select(*keys, "_r.*", "labels")


def timeline(bars: DataFrame, actions: DataFrame, price: str = "close", keep: Sequence[str] = ()) -> DataFrame:
    """Bars and corporate actions of an entity on one time line, in one shuffle.

    Every later step is a window on the same entity partitioning. Rows are either usable
    bars (``is_bar``) or actions; stale, untradable and post-ending bars are gone.
    A delisting ends a series on its date, a merger the day before; delisting wins.
    ``keep`` names further bar columns to carry along.
    """
    tradable = F.col("tradable") if "tradable" in bars.columns else F.lit(True)
    b = bars.select("entity_id", "session", F.col(price).alias("price"), tradable.alias("_ok"), F.lit(True).alias("is_bar"), *keep)
    a = actions.select("entity_id", F.col("effective_date").alias("session"), "kind", "amount", "ratio", F.lit(False).alias("is_bar"))
    whole = Window.partitionBy("entity_id")
    same_day = Window.partitionBy("entity_id", "session")
    dead = F.col("kind") == "DELISTING"
    end = F.struct(
        F.when(dead, 0).otherwise(1).alias("rank"),
        F.when(dead, F.col("session")).otherwise(F.date_sub("session", 1)).alias("last_date"),
        F.coalesce("amount", F.lit(0.0)).alias("final_price"),
        F.when(~dead, F.col("session")).alias("terminal_date"),
    )
    out = b.unionByName(a, allowMissingColumns=True)
    out = out.withColumn("ending", F.min(F.when(F.col("kind").isin(*ENDINGS), end)).over(whole))
    stale = F.coalesce(F.max(F.col("kind") == "STALE_BAR").over(same_day), F.lit(False))
    after = F.coalesce(F.col("session") > F.col("ending.last_date"), F.lit(False))
    out = out.withColumn("_stale", stale).where(~F.col("is_bar") | (F.col("_ok") & ~F.col("_stale") & ~after))
    day = F.when(F.col("is_bar"), F.col("session"))
    return (
        out.withColumn("first_bar", F.min(day).over(whole))
        .withColumn("last_bar", F.max(day).over(whole))
        .drop("_ok", "_stale")
    )


def _with_splits(line: DataFrame) -> DataFrame:
    """Splits after the first bar and up to the last count, from the first bar on or after the ex-date."""
    day = F.col("session")
    used = (F.col("kind") == "SPLIT") & (day > F.col("first_bar")) & (day <= F.col("last_bar"))
    r = F.when(used, F.col("ratio")).otherwise(1.0)
    whole = Window.partitionBy("entity_id")
    upto = whole.orderBy("session", "is_bar").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("split_scale", F.product(r).over(upto) / F.product(r).over(whole)).withColumn(
        "adj_close", F.col("price") * F.col("split_scale")
    )


def _with_targets(line: DataFrame) -> DataFrame:
    """The bar each row lands on: itself, or for actions the first bar on or after."""
    ahead = Window.partitionBy("entity_id").orderBy("session", "is_bar").rowsBetween(0, Window.unboundedFollowing)
    return line.withColumn("target", F.first(F.when(F.col("is_bar"), F.col("session")), ignorenulls=True).over(ahead))


PAYING = ("CASH_DIVIDEND", "SPINOFF")


def split_adjusted(bars: DataFrame, actions: DataFrame, price: str = "close") -> DataFrame:
    """Close in end-of-series share units: factor so far over the factor at the end."""
    out = _with_splits(timeline(bars, actions, price)).where("is_bar")
    return out.select("entity_id", "session", "price", "split_scale", "adj_close")


def distributions_to_session(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Dividends and spun-off value moved to the first bar on or after the ex-date.

    ``status`` says what happened: applied, moved, before_first or after_last.
    """
    out = _with_targets(timeline(bars, actions)).where(F.col("kind").isin(*PAYING) & F.col("amount").isNotNull())
    status = (
        F.when(F.col("session") <= F.col("first_bar"), "before_first")
        .when(F.col("target").isNull(), "after_last")
        .when(F.col("target") > F.col("session"), "moved")
        .otherwise("applied")
    )
    return out.select("entity_id", F.col("session").alias("ex_date"), "target", "amount", status.alias("status"))


def _terminal(line: DataFrame) -> DataFrame:
    """The closing point of an ended series: the day after its last bar, or a merger's date."""
    last = line.where(F.col("is_bar") & F.col("ending").isNotNull() & (F.col("session") == F.col("last_bar")))
    return last.select(
        "entity_id",
        F.coalesce("ending.terminal_date", F.date_add("session", 1)).alias("session"),
        F.col("ending.final_price").alias("adj_close"),
    )


def terminal_points(bars: DataFrame, actions: DataFrame) -> DataFrame:
    return _terminal(timeline(bars, actions))


def total_return(bars: DataFrame, actions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Total-return index per entity with terminal points; bad inputs become error rows.

    Columns named in ``keep`` ride along and are null on terminal points.
    """
    line = _with_targets(_with_splits(timeline(bars, actions, keep=keep)))
    paid = F.col("kind").isin(*PAYING) & (F.col("session") > F.col("first_bar"))
    landing = Window.partitionBy("entity_id", "target")
    dist = F.coalesce(F.sum(F.when(paid, F.col("amount"))).over(landing), F.lit(0.0)) * F.col("split_scale")
    line = line.withColumn("distribution", dist).where("is_bar")
    # An ended series gains its terminal point in place: the last bar row is emitted twice.
    ends = F.col("ending").isNotNull() & (F.col("session") == F.col("last_bar"))
    point = F.struct(F.lit(False).alias("terminal"), "session", "adj_close", "distribution", *keep)
    final = F.struct(
        F.lit(True).alias("terminal"),
        F.coalesce("ending.terminal_date", F.date_add("session", 1)).alias("session"),
        F.col("ending.final_price").alias("adj_close"),
        F.lit(0.0).alias("distribution"),
        *[F.lit(None).cast(line.schema[k].dataType).alias(k) for k in keep],
    )
    pts = line.select("entity_id", F.explode(F.when(ends, F.array(point, final)).otherwise(F.array(point))).alias("p"))
    pts = pts.select("entity_id", "p.*")
    w = by_entity()
    prev = F.lag("adj_close").over(w)
    error = F.when(F.lag("session").over(w) == F.col("session"), "DUPLICATE_SESSION").when(prev <= 0, "NON_POSITIVE_PRICE")
    pts = pts.withColumn("_step", ratio(F.col("adj_close") + F.col("distribution"), prev)).withColumn("error", error)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # The level is null from the first point that would divide by a non-positive price.
    broken = F.max(F.col("error").isNotNull()).over(run)
    level = F.product(F.coalesce("_step", F.lit(1.0))).over(run)
    return pts.withColumn("tr_index", F.when(~broken, level)).drop("_step")


def returns(series: DataFrame, level: str = "tr_index", keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Simple and log return of each point over the one before; logs only of positive levels."""
    prev = F.lag(level).over(Window.partitionBy(*keys).orderBy("session"))
    step = ratio(F.col(level), prev)
    out = series.withColumn("simple_return", step - 1).withColumn("log_return", F.when(step > 0, F.ln(step)))
    return out.where(F.col("simple_return").isNotNull())


def series_asof(requests: DataFrame, series: DataFrame, date: str, prefix: str = "", level: str = "tr_index") -> DataFrame:
    """Last point of the entity's series at or before each requested date."""
    s = series.select("entity_id", F.col("session").alias(f"{prefix}session"), F.col(level).alias(f"{prefix}level"))
    return asof_join(requests, s, ["entity_id"], date, f"{prefix}session", [f"{prefix}session", f"{prefix}level"], segment=month_of)


def period_return(requests: DataFrame, series: DataFrame, start: str, end: str) -> DataFrame:
    """Return between the as-of points of two dates."""
    series = materialise(series)
    out = series_asof(materialise(series_asof(requests, series, start, "start_")), series, end, "end_")
    return out.withColumn("period_return", ratio(F.col("end_level"), F.col("start_level")) - 1)


def monthly_returns(daily: DataFrame, value: str = "simple_return", keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    month = F.trunc("session", "month").alias("month")
    return daily.groupBy(*keys, month).agg((F.product(F.col(value) + 1) - 1).alias("monthly_return"))


def carry_closes(bars: DataFrame, sessions: DataFrame, price: str = "close") -> DataFrame:
    """Close known at every session, carried forward from the last bar.

    Each bar is expanded over the sessions until the next one: no calendar x entity grid.
    """
    b = with_index(bars, sessions)
    last = sessions.agg(F.max("idx")).scalar()
    nxt = F.coalesce(F.lead("idx").over(by_entity()) - 1, last)
    b = b.withColumn("_until", nxt)
    idx = F.explode(F.sequence("idx", "_until")).alias("idx")
    rows = b.select("entity_id", F.col(price).alias("carried_close"), F.col("session").alias("bar_session"), idx)
    return rows.join(F.broadcast(sessions), "idx")


def distorting_sessions(held: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions inside holding spans (``held_from``..``held_to``) with no tradable bar."""
    d = sessions.select("session")
    cut = interval_join(held, d, [], "held_from", "held_to", "session", unit="month", closed=True)
    good = bars.where("tradable") if "tradable" in bars.columns else bars
    return cut.select("entity_id", "session").distinct().join(good, ["entity_id", "session"], "left_anti")


