"""Calendar and release-lag queries, driven by the dates found in the tables."""

from pyspark.sql import functions as F

from knownwhen.operators import calendars as cal
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS


def _fixed(month, day, sat=True):
    back = f"or (isodow(day) = 5 and month(day + 1) = {month} and day(day + 1) = {day})" if sat else ""
    return (
        f"((month(day) = {month} and day(day) = {day} and isodow(day) <= 5) or (isodow(day) = 1 and month(day - 1) = {month}"
        f" and day(day - 1) = {day}) {back})"
    )


def _nth(month, dow, n, x="day"):
    return f"(month({x}) = {month} and isodow({x}) = {dow} and (day({x}) - 1) // 7 = {n - 1})"


_LAST_MAY = "(month(day) = 5 and isodow(day) = 1 and day(day) > 24)"

SQL_VIEWS["easter_days"] = """
select y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) as easter from (
  select *, (a + 11 * h + 22 * l) // 451 as m from (
    select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from (
      select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from (
        select y, y % 19 as a, y // 100 as b, y % 100 as c from range(1990, 2031) r(y)))))"""
SQL_VIEWS["cal_days"] = f"""
select *, isodow(day) <= 5 and not holiday and not strftime(day, '%Y-%m-%d') in ('2001-09-11', '2001-09-12', '2001-09-13',
    '2001-09-14', '2004-06-11', '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05', '2025-01-09') as is_session,
  {_nth(11, 4, 4, "(day - 1)")} or (((month(day) = 7 and day(day) = 3) or (month(day) = 12 and day(day) = 24))
    and isodow(day) <= 5 and not holiday) as early,
  {_fixed(1, 1)} or {_nth(1, 1, 3)} or {_nth(2, 1, 3)} or {_LAST_MAY} or (year(day) >= 2021 and {_fixed(6, 19)})
    or {_fixed(7, 4)} or {_nth(9, 1, 1)} or {_nth(10, 1, 2)} or {_fixed(11, 11)} or {_nth(11, 4, 4)}
    or {_fixed(12, 25)} as fed
from (select day, {_fixed(1, 1, False)} or {_nth(1, 1, 3)} or {_nth(2, 1, 3)} or day + 2 = easter or {_LAST_MAY}
    or (year(day) >= 2022 and {_fixed(6, 19)}) or {_fixed(7, 4)} or {_nth(9, 1, 1)} or {_nth(11, 4, 4)}
    or {_fixed(12, 25)} as holiday
  from (select cast(unnest(generate_series(timestamp '1994-12-01', timestamp '2024-12-31', interval 1 day)) as date) as day)
  join easter_days on y = year(day))"""
SQL_VIEWS["xnys"] = """
select day as session, row_number() over (order by day) as idx, early,
  timezone('UTC', timezone('America/New_York', day + interval 570 minute)) as open_at,
  timezone('UTC', timezone('America/New_York', day + case when early then interval 13 hour else interval 16 hour end)) as close_at
from cal_days where is_session"""
NY_DAY = "cast(timezone('America/New_York', timezone('UTC', {})) as date)"
NY_AT = "timezone('UTC', timezone('America/New_York', cast({} as timestamp) + interval {} minute))"


def span(df, col):
    """First and last date of a column, padded so neighbouring sessions exist."""
    d = F.col(col).cast("date")
    return df.agg(F.date_sub(F.min(d), 30).alias("first"), F.date_add(F.max(d), 60).alias("last"))


@query(
    "session_calendar",
    "session:d open_at:t close_at:t early:b n_lines:i",
    """select session, open_at, close_at, early, count(l_orderkey) as n_lines
       from xnys left join lineitem on cast(l_shipdate as date) = session
       where session between (select min(l_shipdate) from lineitem) and (select max(l_shipdate) from lineitem)
       group by all""",
)
def _(t):
    d = F.col("l_shipdate").cast("date")
    s = cal.session_calendar(t.lineitem.agg(F.min(d).alias("first"), F.max(d).alias("last")))
    n = t.lineitem.groupBy(d.alias("session")).agg(F.count(F.lit(1)).alias("n_lines"))
    return s.join(n, "session", "left").select(
        "session", "open_at", "close_at", F.col("early_close").alias("early"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


@query(
    "federal_calendar",
    "day:d n_orders:i",
    """select day, count(o_orderkey) as n_orders from cal_days left join orders on cast(o_orderdate as date) = day
       where fed and day between (select min(o_orderdate) from orders) and (select max(o_orderdate) from orders) group by 1""",
)
def _(t):
    d = F.col("o_orderdate").cast("date")
    days = cal.days_between(t.orders.agg(F.min(d).alias("first"), F.max(d).alias("last")))
    days = days.where(cal.is_federal_holiday(F.col("day")))
    n = t.orders.where(cal.is_federal_holiday(d)).groupBy(d.alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    return days.join(n, "day", "left").select("day", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query(
    "prev_next_session",
    "event_id:i previous_session:d following_session:d",
    """select event_id, (select max(session) from xnys where close_at <= ts) as previous_session,
         (select min(session) from xnys where open_at > ts) as following_session from events""",
)
def _(t):
    return cal.prev_next_session(t.events, "ts", cal.day_table(span(t.events, "ts")))


@query(
    "weekly_decision_sessions",
    "week:d session:d",
    """select date_trunc('week', session) as week, max(session) as session from xnys
       where session between (select min(o_orderdate) from orders) and (select max(o_orderdate) from orders) group by 1""",
)
def _(t):
    d = F.col("o_orderdate").cast("date")
    return cal.weekly_decisions(cal.session_calendar(t.orders.agg(F.min(d).alias("first"), F.max(d).alias("last"))))


_FILING = f"""
select event_id, ts, x.is_session and ts <= {NY_AT.format(NY_DAY.format('ts'), 1050)} as same,
  (select min(session) from xnys where session > {NY_DAY.format('ts')}) as nxt
from events join cal_days x on x.day = {NY_DAY.format('ts')}"""


@query(
    "lag_filings",
    "event_id:i release_at:t after_hours:b",
    f"""select event_id, case when same then ts else {NY_AT.format('nxt', 360)} end as release_at, not same as after_hours
        from ({_FILING})""",
)
def _(t):
    return cal.filing_release(t.events, "ts", cal.day_table(span(t.events, "ts")))


@query(
    "lag_insider",
    "event_id:i deadline_at:t release_at:t after_hours:b late:b",
    f"""select event_id, deadline_at, release_at, after_hours, ts > deadline_at as late from (
        select f.event_id, f.ts, case when same then f.ts else {NY_AT.format('nxt', 360)} end as release_at,
          not same as after_hours, {NY_AT.format("due.session", 1320)} as deadline_at
        from ({_FILING}) f join events e using (event_id)
        join xnys due on due.idx = (select max(idx) from xnys where session <= cast(e.ts as date) - cast(e.event_id % 6 as int)) + 2)""",
)
def _(t):
    traded = F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 6).cast("int"))
    return cal.insider_lag(t.events.withColumn("traded", traded), "traded", "ts", cal.day_table(span(t.events, "ts")))


@query(
    "lag_positions",
    "report:d release_at:t flags:s n:i",
    f"""with r as (select cast(o_orderdate as date) as report, count(*) as n from orders group by 1),
        a as (select *, report + cast((9 - isodow(report)) % 7 as int) as tue from r),
        h as (select *, (select bool_or(fed) from cal_days where day between tue and tue + 3) as delayed,
          (select fed from cal_days where day = tue) as tue_fed from a)
        select report, n, case when delayed then {NY_AT.format("(select min(day) from cal_days where day >= tue + 6 and isodow(day) <= 5 and not fed)", 930)}
            else {NY_AT.format("tue + 3", 930)} end as release_at,
          concat_ws(',', case when delayed then 'RELEASE_DELAYED' end,
            case when tue_fed or report <> tue then 'AVAILABLE_AT_ESTIMATED' end) as flags from h""",
)
def _(t):
    r = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("report")).agg(F.count(F.lit(1)).alias("n"))
    return cal.positions_release(r, "report").withColumn("flags", F.array_join("release_flags", ","))


@query(
    "lag_bars",
    "session:d available_at:t n:i",
    """select session, close_at + interval 60 minute as available_at, count(*) as n
       from lineitem join xnys on session = cast(l_shipdate as date) group by all""",
)
def _(t):
    s = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("session")).agg(F.count(F.lit(1)).alias("n"))
    on = cal.on_day(s, cal.day_table(span(t.lineitem, "l_shipdate")), F.col("session")).where("is_session")
    return on.withColumn("available_at", cal.bar_release(F.col("close_at")))


@query(
    "lag_macro",
    "vintage:d available_at:t n:i",
    f"""select cast(o_orderdate as date) as vintage, {NY_AT.format("cast(o_orderdate as date)", 510)} as available_at, count(*) as n
        from orders group by all""",
)
def _(t):
    s = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("vintage")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("available_at", cal.macro_release(F.col("vintage")))


@query(
    "lag_rates",
    "day:d available_at:t n:i",
    f"""select cast(o_orderdate as date) as day, {NY_AT.format("cast(o_orderdate as date)", 960)} as available_at, count(*) as n
        from orders group by all""",
)
def _(t):
    s = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("available_at", cal.rates_release(F.col("day")))


@query(
    "lag_13f",
    "quarter_end:d deadline_at:t n:i",
    f"""select quarter_end, {NY_AT.format("quarter_end + 45", 1050)} as deadline_at, n from (
        select cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 month) as date) as quarter_end, count(*) as n
        from orders group by 1)""",
)
def _(t):
    q = cal.quarter_end(F.col("o_orderdate").cast("date"))
    s = t.orders.groupBy(q.alias("quarter_end")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("deadline_at", cal.ownership_deadline(F.col("quarter_end")))


@query(
    "nth_session_after",
    "decided:d due:d window_end:d owed:d n:i",
    """with o as (select cast(o_orderdate as date) as decided, count(*) as n from orders group by 1),
       i as (select *, (select max(idx) from xnys where session <= decided) as here from o)
       select decided, n, a.session as due, b.session as window_end, c.session as owed from i
       join xnys a on a.idx = here + 1 join xnys b on b.idx = here + 5 join xnys c on c.idx = here + 10""",
)
def _(t):
    o = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("decided")).agg(F.count(F.lit(1)).alias("n"))
    days = cal.day_table(span(t.orders, "o_orderdate"))
    for n, name in ((1, "due"), (5, "window_end"), (10, "owed")):
        o = cal.nth_session_after(o, "decided", n, days, name)
    return o
