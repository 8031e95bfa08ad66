"""Clusters of insiders' purchases over a trailing window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.session import materialise, written

# A cluster's trailing days, spacing, owners and amounts, and the oldest trade a filing may report.
WINDOW_DAYS, SPACING_DAYS, STALE_DAYS = 30, 90, 10
MIN_OWNERS, MIN_TRADE, MIN_CLUSTER = 2, 25_000, 100_000


def qualifying(trades: DataFrame, code: str) -> DataFrame:
    """Open-market trades (``code`` P or S) of officers and directors of 25,000 or more.

    ``trades`` carries issuer, owner, code, acquired, price, shares, officer, director, plan, traded, accepted
    (dates). A purchase is acquired, outside a trading plan and filed within ten days. What is missing does not
    qualify, save ``plan``: old filings have no such flag.
    """
    value = F.col("price") * F.col("shares")
    insider = F.coalesce("officer", F.lit(False)) | F.coalesce("director", F.lit(False))
    out = trades.where((F.col("code") == code) & insider & (F.col("price") > 0) & (value >= MIN_TRADE))
    if code == "P":
        out = out.where((F.col("acquired") == "A") & ~F.coalesce("plan", F.lit(False)) & (F.datediff("accepted", "traded") <= STALE_DAYS))
    return out.where("issuer is not null and owner is not null and traded is not null and accepted is not null").withColumn("value", value)


def _active(trades: DataFrame) -> DataFrame:
    """Days on which a trade is known and within the trailing window: [start, stop)."""
    x = trades.withColumn("start", F.greatest("accepted", "traded")).withColumn("stop", F.date_add("traded", WINDOW_DAYS + 1))
    return x.where("start < stop")


def _edges(spans: DataFrame, **cols: Column) -> DataFrame:
    """+x on the first and -x on the day after the last day of each span, summed by issuer and day before anything else."""
    up = spans.select("issuer", F.col("start").alias("day"), *[x.alias(n) for n, x in cols.items()])
    down = spans.select("issuer", F.col("stop").alias("day"), *[(-x).alias(n) for n, x in cols.items()])
    return up.unionByName(down).groupBy("issuer", "day").agg(*[F.sum(n).alias(n) for n in cols])


def _owner_spans(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of one owner as one, so that edges count distinct owners."""
    day = spans.groupBy("issuer", "owner", "start").agg(F.max("stop").alias("stop"))
    w = Window.partitionBy("issuer", "owner").orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = day.withColumn("_new", (before.isNull() | (F.col("start") > before)).cast("int"))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("issuer", "owner", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def cluster_states(purchases: DataFrame, sales: DataFrame) -> DataFrame:
    """Distinct owners, amount and sales of the trailing 30 days, as intervals [day, until) between changes.

    A window cannot count distinct owners over a trailing range. Here the spans in which each owner is
    present are merged, and their edges summed by issuer and day; all windows run over at most one row per
    day, so an issuer or an owner with very many trades is no hot task.
    """
    p, s = _active(purchases), _active(sales)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    owners = _edges(_owner_spans(p), owners=one)
    edges = _edges(p, value=F.col("value")).unionByName(owners, allowMissingColumns=True).unionByName(_edges(s, sold=one), allowMissingColumns=True)
    names = ("owners", "value", "sold")
    edges = edges.groupBy("issuer", "day").agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])
    w = Window.partitionBy("issuer").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = edges.withColumns({n: F.sum(n).over(upto) for n in names}).withColumn("until", F.lead("day").over(w))
    return out.where(F.col("until").isNotNull())


def insider_cluster(purchases: DataFrame, sales: DataFrame) -> DataFrame:
    """Cluster events: issuer, day, owners, value, reinforcing.

    A day meets the condition when two or more owners bought 100,000 or more together in the trailing 30
    days and nobody sold. The first such day is an event; the next event is the first such day 90 or more days
    later. ``reinforcing`` counts the purchases filed after an event and before its 90th day. Equal rows
    count as often as they occur; without purchases there is no event.

    Events within one interval of equal state follow from arithmetic; an issuer's intervals, at most one per
    day, are folded once.
    """
    # Trades are read four times; what they come from is worked out once.
    purchases, sales = written(purchases.select("issuer", "owner", "traded", "accepted", "value")), written(sales.select("issuer", "traded", "accepted"))
    enough = (F.col("owners") >= MIN_OWNERS) & (F.col("value") >= MIN_CLUSTER) & (F.col("sold") == 0)
    met = materialise(cluster_states(purchases, sales).where(enough))
    spans = met.groupBy("issuer").agg(F.array_sort(F.collect_list(F.struct("day", "until", "owners", "value"))).alias("spans"))
    days = F.array().cast("array<date>")

    def step(acc, x):
        due = F.date_add(F.try_element_at(acc, F.lit(-1)), SPACING_DAYS)
        first = F.coalesce(F.greatest(x["day"], due), x["day"])
        more = F.sequence(first, F.greatest(first, F.date_sub(x["until"], 1)), F.make_dt_interval(F.lit(SPACING_DAYS)))
        return F.concat(acc, F.when(first < x["until"], more).otherwise(days))

    fired = spans.select("issuer", F.aggregate("spans", days, step).alias("days"))
    events = fired.select("issuer", F.explode("days").alias("day"))
    ev = events.join(met.withColumnRenamed("day", "_from"), "issuer").where("day >= _from and day < until").select("issuer", "day", "owners", "value")

    # Filings are counted by day first; an issuer's events are few, one in 90 days.
    filed = _active(purchases).groupBy("issuer", F.col("start").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    near = F.filter("days", lambda d: (d < F.col("_day")) & (F.datediff(F.col("_day"), d) < SPACING_DAYS))
    later = filed.join(fired, "issuer").select("issuer", F.explode(near).alias("day"), "_n").groupBy("issuer", "day").agg(F.sum("_n").alias("reinforcing"))
    return ev.join(later, ["issuer", "day"], "left").withColumn("reinforcing", F.coalesce("reinforcing", F.lit(0).cast("bigint")))
