"""Insider clusters over lines as trades of a customer's group, suppliers as owners."""

from pyspark.sql import functions as F

from knownwhen.operators import insiders as ins
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS

SQL_VIEWS["insider_trades"] = """
select o_custkey // 20 as issuer, l_suppkey % 11 as owner, case when l_returnflag = 'R' and l_linenumber % 4 = 3 then 'S' else 'P' end as code,
  'A' as acquired, cast(l_extendedprice as decimal(18, 2)) as value, l_linenumber % 5 <> 4 as officer, l_partkey % 9 = 0 as plan,
  cast(o_orderdate as date) - cast(l_linenumber * 2 % 13 as int) as traded, cast(o_orderdate as date) as accepted
from lineitem join orders on l_orderkey = o_orderkey"""
SQL_VIEWS["insider_buys"] = f"""
select * from insider_trades where code = 'P' and officer and not plan and value >= {ins.MIN_TRADE} and accepted - traded <= {ins.STALE_DAYS}"""
SQL_VIEWS["insider_sales"] = f"""
select * from insider_trades where code = 'S' and officer and value >= {ins.MIN_TRADE}"""
SQL_VIEWS["insider_days"] = f"""
with d as (select issuer, cast(unnest(generate_series(accepted, traded + {ins.WINDOW_DAYS}, interval 1 day)) as date) as day, owner, value from insider_buys where accepted <= traded + {ins.WINDOW_DAYS}),
  s as (select distinct issuer, cast(unnest(generate_series(accepted, traded + {ins.WINDOW_DAYS}, interval 1 day)) as date) as day from insider_sales where accepted <= traded + {ins.WINDOW_DAYS})
select issuer, day, count(distinct owner) as owners, sum(value) as value, bool_or(s.day is not null) as sold from d left join s using (issuer, day) group by 1, 2"""
SQL_VIEWS["insider_met"] = f"""
select * from insider_days where owners >= {ins.MIN_OWNERS} and value >= {ins.MIN_CLUSTER} and not sold"""
SQL_VIEWS["insider_next"] = f"""
select *, min(day) over (partition by issuer order by day range between interval {ins.SPACING_DAYS} day following and unbounded following) as next_day from insider_met"""
SQL_VIEWS["insider_events"] = """
select issuer, min(day) as day from insider_met group by 1
union all select n.issuer, n.next_day from insider_events e join insider_next n on n.issuer = e.issuer and n.day = e.day and n.next_day is not null"""


def trades(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_custkey") / 20).alias("issuer"), F.col("o_orderdate").cast("date").alias("accepted"))
    n = F.col("l_linenumber")
    return t.lineitem.join(o, "l_orderkey").select(
        "issuer", (F.col("l_suppkey") % 11).alias("owner"), F.when((F.col("l_returnflag") == "R") & (n % 4 == 3), "S").otherwise("P").alias("code"),
        F.lit("A").alias("acquired"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.lit(1).alias("shares"),
        (n % 5 != 4).alias("officer"), F.lit(None).cast("boolean").alias("director"), (F.col("l_partkey") % 9 == 0).alias("plan"),
        F.date_sub("accepted", (n * 2 % 13).cast("int")).alias("traded"), "accepted",
    )


@query("cluster_states", "issuer:i days:i owners:i value:f2 met:i", f"""
    select issuer, count(*) as days, sum(owners) as owners, sum(value) as value, count(*) filter (owners >= {ins.MIN_OWNERS} and value >= {ins.MIN_CLUSTER} and not sold) as met from insider_days group by 1""")
def _(t):
    """Days of each issuer with a purchase in the window, with their owners and amounts summed."""
    x = trades(t)
    s = ins.cluster_states(ins.qualifying(x, "P"), ins.qualifying(x, "S")).where("owners > 0").withColumn("n", F.datediff("until", "day"))
    ok = (F.col("owners") >= ins.MIN_OWNERS) & (F.col("value") >= ins.MIN_CLUSTER) & (F.col("sold") == 0)
    return s.groupBy("issuer").agg(
        F.sum("n").alias("days"), F.sum(F.col("n") * F.col("owners")).alias("owners"), F.sum(F.col("n") * F.col("value")).alias("value"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("met"),
    )


@query(
    "insider_cluster", "issuer:i day:d owners:i value:f2 reinforcing:i",
    f"""select e.issuer, e.day, m.owners, m.value, count(b.accepted) as reinforcing from insider_events e join insider_met m using (issuer, day)
        left join insider_buys b on b.issuer = e.issuer and b.accepted > e.day and b.accepted < e.day + {ins.SPACING_DAYS} group by all""",
)
def _(t):
    x = trades(t)
    return ins.insider_cluster(ins.qualifying(x, "P"), ins.qualifying(x, "S"))
