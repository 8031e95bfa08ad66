"""Exchange and federal calendars and the release-lag rules built on them.

Whether a date is a session is a column expression, so filters need no join. Lookups
of neighbouring sessions join a day table of at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import minutes_after, ny_date, ny_instant

# Full-day closures no rule derives.
ADHOC_CLOSURES = (
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
)
MON, THU, FRI = 0, 3, 4


def with_easter(df: DataFrame, day: str = "day") -> DataFrame:
    """Add ``_easter``, Easter Sunday of the day's year, by the published anonymous algorithm.

    Steps are columns of their own, so that none is expanded into the next.
    """

    def div(a, b):
        return F.floor(a / b)

    y, century, golden = F.col("_y"), F.col("_c"), F.col("_g")
    epact, wday, n = F.col("_h"), F.col("_l"), F.col("_n")
    steps = {
        "_y": F.year(day),
        "_c": div(y, 100),
        "_g": y % 19,
        "_h": (golden * 19 + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30,
        "_l": ((century % 4) * 2 + div(y % 100, 4) * 2 + 32 - epact - y % 4) % 7,
        "_n": epact + wday - div(golden + epact * 11 + wday * 22, 451) * 7 + 114,
        "_easter": F.make_date(y, div(n, 31).cast("int"), (n % 31 + 1).cast("int")),
    }
    for name, x in steps.items():
        df = df.withColumn(name, x)
    return df.drop(*[k for k in steps if k != "_easter"])


def _nth(d: Column, month: int, dow: int, nth: int) -> Column:
    day = F.dayofmonth(d)
    return (F.month(d) == month) & (F.weekday(d) == dow) & day.between(7 * nth - 6, 7 * nth)


def _last(d: Column, month: int, dow: int) -> Column:
    return (F.month(d) == month) & (F.weekday(d) == dow) & (F.dayofmonth(d) > F.dayofmonth(F.last_day(d)) - 7)


def _fixed(d: Column, month: int, day: int, *, saturday_back: bool = True) -> Column:
    """A fixed holiday falls on d: itself on weekdays, Friday before or Monday after a weekend."""

    def on(x: Column) -> Column:
        return (F.month(x) == month) & (F.dayofmonth(x) == day)

    dow = F.weekday(d)
    hit = (on(d) & (dow < 5)) | ((dow == MON) & on(F.date_sub(d, 1)))
    return hit | ((dow == FRI) & on(F.date_add(d, 1))) if saturday_back else hit


def is_exchange_holiday(d: Column, easter: Column) -> Column:
    y = F.year(d)
    return (
        _fixed(d, 1, 1, saturday_back=False)
        | _nth(d, 1, MON, 3)
        | _nth(d, 2, MON, 3)
        | (F.date_add(d, 2) == easter)
        | _last(d, 5, MON)
        | ((y >= 2022) & _fixed(d, 6, 19))
        | _fixed(d, 7, 4)
        | _nth(d, 9, MON, 1)
        | _nth(d, 11, THU, 4)
        | _fixed(d, 12, 25)
    )


def is_federal_holiday(d: Column) -> Column:
    """Observed federal holidays; a Saturday new year falls on the Friday before."""
    return (
        _fixed(d, 1, 1)
        | _nth(d, 1, MON, 3)
        | _nth(d, 2, MON, 3)
        | _last(d, 5, MON)
        | ((F.year(d) >= 2021) & _fixed(d, 6, 19))
        | _fixed(d, 7, 4)
        | _nth(d, 9, MON, 1)
        | _nth(d, 10, MON, 2)
        | _fixed(d, 11, 11)
        | _nth(d, 11, THU, 4)
        | _fixed(d, 12, 25)
    )


def is_federal_business_day(d: Column) -> Column:
    return (F.weekday(d) < 5) & ~is_federal_holiday(d)


def days_between(span: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row per calendar day of a one-row span."""
    return span.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("day"))


def exchange_days(span: DataFrame, adhoc: tuple[str, ...] = ADHOC_CLOSURES) -> DataFrame:
    """Every calendar day of a span: session or not, early close, open and close instants."""
    d = F.col("day")
    x = with_easter(days_between(span))
    x = x.withColumn("_hol", is_exchange_holiday(d, F.col("_easter")))
    closed = d.isin(*[F.lit(c).cast("date") for c in adhoc]) if adhoc else F.lit(False)
    x = x.withColumn("is_session", (F.weekday(d) < 5) & ~F.col("_hol") & ~closed)
    eve = ((F.month(d) == 7) & (F.dayofmonth(d) == 3)) | ((F.month(d) == 12) & (F.dayofmonth(d) == 24))
    early = _nth(F.date_sub(d, 1), 11, THU, 4) | (eve & (F.weekday(d) < 5) & ~F.col("_hol"))
    x = x.withColumn("early_close", F.col("is_session") & early)
    on = F.col("is_session")
    close = F.when(F.col("early_close"), ny_instant(d, "13:00")).otherwise(ny_instant(d, "16:00"))
    x = x.withColumn("open_at", F.when(on, ny_instant(d, "09:30"))).withColumn("close_at", F.when(on, close))
    # Grouping by day changes nothing but stops a filter on ``is_session`` from being pushed through
    # these rules into whatever table the calendar is joined with.
    return x.groupBy("day").agg(*[F.first(c).alias(c) for c in ("is_session", "early_close", "open_at", "close_at")])


def session_calendar(span: DataFrame) -> DataFrame:
    """Sessions of a span with dense index, open and close. Bounded: one row per day."""
    idx = F.row_number().over(Window.orderBy("day")).cast("bigint")
    s = exchange_days(span).where("is_session")
    return s.select(F.col("day").alias("session"), idx.alias("idx"), "open_at", "close_at", "early_close")


DAY_COLUMNS = ("day", "is_session", "early_close", "open_at", "close_at", "prev_session", "next_session", "next_close_at", "session_idx")


def day_table(span: DataFrame) -> DataFrame:
    """Every calendar day with its own session and the neighbouring ones (at most 366 rows a year)."""
    here, close = F.when(F.col("is_session"), F.col("day")), F.col("close_at")
    back = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return exchange_days(span).select(
        "day", "is_session", "early_close", "open_at", "close_at",
        F.last(here, ignorenulls=True).over(back).alias("prev_session"),
        F.first(here, ignorenulls=True).over(ahead).alias("next_session"),
        F.first(close, ignorenulls=True).over(ahead).alias("next_close_at"),
        F.count(here).over(upto).alias("session_idx"),
    )


def on_day(df: DataFrame, days: DataFrame, date: Column) -> DataFrame:
    """Attach the day table by date. Its size is bounded by the calendar, hence the broadcast."""
    return df.withColumn("day", date).join(F.broadcast(days), "day", "left")


def prev_next_session(df: DataFrame, instant: str, days: DataFrame) -> DataFrame:
    """Last session closed by an instant and first session that opens after it."""
    at, d = F.col(instant), F.col("day")
    out = on_day(df, days, ny_date(at))
    closed = F.coalesce(F.col("close_at") <= at, F.lit(False))
    ahead = F.coalesce(F.col("open_at") > at, F.lit(False))
    return out.withColumn("previous_session", F.when(closed, d).otherwise(F.col("prev_session"))).withColumn(
        "following_session", F.when(ahead, d).otherwise(F.col("next_session"))
    ).drop(*DAY_COLUMNS)


def weekly_decisions(sessions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Last session of each Monday-keyed week; the end of the range ends a week."""
    week = F.date_trunc("week", F.col("session")).cast("date").alias("week")
    return sessions.groupBy(*by, week).agg(F.max("session").alias("session"))


def filing_release(df: DataFrame, accepted: str, days: DataFrame) -> DataFrame:
    """Filings accepted after 17:30 New York or off-session appear at 06:00 of the next session."""
    at, d = F.col(accepted), F.col("day")
    out = on_day(df, days, ny_date(at))
    same = F.col("is_session") & (at <= ny_instant(d, "17:30"))
    return (
        out.withColumn("release_at", F.when(same, at).otherwise(ny_instant(F.col("next_session"), "06:00")))
        .withColumn("after_hours", ~same)
        .drop(*DAY_COLUMNS)
    )


def nth_session_after(df: DataFrame, date: str, n: Column | int, days: DataFrame, name: str = "nth_session") -> DataFrame:
    """The session n places after the last session at or before a date."""
    n = F.lit(n) if isinstance(n, int) else n
    idx = days.select("day", F.col("session_idx").alias("_i"))
    target = days.where("is_session").select(F.col("day").alias(name), F.col("session_idx").alias("_j"))
    out = df.join(F.broadcast(idx), F.col(date).cast("date") == F.col("day"), "left").withColumn("_j", F.col("_i") + n)
    return out.join(F.broadcast(target), "_j", "left").drop("day", "_i", "_j")


def insider_lag(df: DataFrame, traded: str, accepted: str, days: DataFrame) -> DataFrame:
    """Deadline 22:00 of the second session after a trade; later acceptance is late."""
    out = nth_session_after(df, traded, 2, days, "_due").withColumn("deadline_at", ny_instant(F.col("_due"), "22:00"))
    out = filing_release(out, accepted, days)
    return out.withColumn("late", F.col(accepted) > F.col("deadline_at")).drop("_due")


def positions_release(df: DataFrame, report: str) -> DataFrame:
    """Weekly positions as of Tuesday appear Friday 15:30, or after a holiday from Monday on.

    A report date on another weekday uses the next Tuesday and marks the instant estimated.
    The rule runs once per distinct date (bounded by the calendar), not once per row.
    """
    r, d = F.col(report), F.col("day")
    reports = df.select(report).where(r.isNotNull()).distinct()
    span = reports.agg(F.min(r).alias("first"), F.date_add(F.max(r), 20).alias("last"))
    w = Window.orderBy("day")
    table = days_between(span).withColumn("_fed", is_federal_holiday(d))
    work = F.when((F.weekday(d) < 5) & ~F.col("_fed"), d)
    table = table.select(
        d.alias("_tuesday"),
        F.col("_fed"),
        F.max("_fed").over(w.rowsBetween(0, 3)).alias("_delayed"),
        F.first(work, ignorenulls=True).over(w.rowsBetween(6, 12)).alias("_later"),
    )
    days = reports.withColumn("_tuesday", F.date_add(r, (F.lit(8) - F.weekday(r)) % 7)).join(F.broadcast(table), "_tuesday")
    delayed = F.col("_delayed")
    day = F.when(delayed, F.col("_later")).otherwise(F.date_add("_tuesday", 3))
    estimated = (delayed & F.col("_fed")) | (F.weekday(r) != 1)
    flags = F.array_compact(
        F.array(F.when(delayed, F.lit("RELEASE_DELAYED")), F.when(estimated, F.lit("AVAILABLE_AT_ESTIMATED")))
    )
    days = days.select(report, ny_instant(day, "15:30").alias("release_at"), flags.alias("release_flags"))
    return df.join(F.broadcast(days), report, "left")


def bar_release(close_at: Column) -> Column:
    """Daily bars are published an hour after the close."""
    return minutes_after(close_at, 60)


def macro_release(vintage: Column) -> Column:
    return ny_instant(vintage, "08:30")


def rates_release(day: Column) -> Column:
    return ny_instant(day, "16:00")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def ownership_deadline(day: Column) -> Column:
    """Quarterly ownership reports: 45 days after the quarter end, 17:30 New York."""
    return ny_instant(F.date_add(quarter_end(day), 45), "17:30")
