"""Views of the driver tables in the shapes the operators take.

Each view is written twice, as a DataFrame and as DuckDB text, side by side so that
an operator and its SQL check read the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Processing delay in minutes by source prefix, as configuration.
DELAYS = {"view": 15, "click": 15, "purchase": 60, "err": 0, "sign": 1440, "si": 5}
FALLBACK_DELAY = 60

SQL_VIEWS: dict[str, str] = {}


def _delay_sql(col: str) -> str:
    cases = " ".join(
        f"when starts_with({col}, '{p}') then {DELAYS[p]}" for p in sorted(DELAYS, key=len, reverse=True)
    )
    return f"case {cases} else {FALLBACK_DELAY} end"


SQL_VIEWS["obs"] = f"""
select event_id as id, event_type as source_id, concat('loc-', event_id % 3) as source_locator,
  cast(user_id as varchar) as entity_id, cast(date_trunc('week', ts) as timestamp) as effective_at,
  ts as available_at, case when event_type in ('view', 'click') then ts end as vintage_at, value,
  case when event_id % 53 = 0 then 'ARTIFACT_MISSING' when event_id % 17 = 0 then 'STALE_BAR' else '' end as flag,
  {_delay_sql('event_type')} as delay_min
from events"""

SQL_VIEWS["decisions"] = """
select distinct cast(date_trunc('day', ts) as timestamp) + interval 18 hour as decision_at from events"""

_BARS = """
select {ent} as entity_id, cast(l_shipdate as date) as session,
  cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / count(*) as close,
  cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) / count(*) as open,
  max(l_extendedprice) as high, min(l_extendedprice * (1 - l_discount)) as low,
  cast(sum(l_quantity) as bigint) as volume, min(l_orderkey) as id
from lineitem join part on p_partkey = l_partkey
where isodow(l_shipdate) <= 5 group by 1, 2"""
SQL_VIEWS["bars"] = _BARS.format(ent="p_type")
SQL_VIEWS["bars_sparse"] = _BARS.format(ent="p_brand")
SQL_VIEWS["sessions"] = """
select session, row_number() over (order by session) as idx from (select distinct session from bars)"""

SQL_VIEWS["actions"] = """
select distinct entity_id, 'CASH_DIVIDEND' as kind, cast(date_trunc('quarter', session) as date) as effective_date,
  100.0 as amount, cast(null as double) as ratio from bars
union all select entity_id, 'SPLIT', min(session), null, 2.0 from bars
where entity_id in ('LARGE', 'PROMO') and session >= date '1998-01-01' group by entity_id
union all select entity_id, 'DELISTING', date '2001-06-29', 500.0, null from bars
where entity_id = 'SMALL' group by entity_id"""

SQL_VIEWS["fill_days"] = """
select day, coalesce((select min(session) from sessions s where s.session >= day), (select max(session) from sessions)) as session
from (select distinct cast(l_shipdate as date) as day from lineitem)"""

SQL_VIEWS["fills"] = """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice * 100 as bigint),
    cast(l_quantity as bigint)) as fill_id,
  l_suppkey % 20 as account, p_type as entity_id, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side,
  cast(l_quantity as bigint) as qty, l_extendedprice as price, session,
  l_extendedprice * l_quantity * 0.0001 as fee
from lineitem join part on p_partkey = l_partkey join fill_days on day = cast(l_shipdate as date)"""


def _bars(t: Tables, entity: str) -> DataFrame:
    li = t.lineitem.where(F.weekday("l_shipdate") < 5).join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col(entity).alias("entity_id")), "l_partkey"
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    n = F.count(F.lit(1))
    return li.groupBy("entity_id", F.col("l_shipdate").cast("date").alias("session")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / n).alias("close"),
        (F.sum(net.cast("decimal(18,4)")).cast("double") / n).alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min(net).alias("low"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
        F.min("l_orderkey").alias("id"),
    )


class Tables:
    """Lazy access to the base tables of one directory and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    @cached_property
    def obs(self) -> DataFrame:
        n = F.col("event_id")
        return self.events.select(
            n.alias("id"),
            F.col("event_type").alias("source_id"),
            F.concat(F.lit("loc-"), n % 3).alias("source_locator"),
            F.col("user_id").cast("string").alias("entity_id"),
            F.date_trunc("week", "ts").cast("timestamp_ntz").alias("effective_at"),
            F.col("ts").alias("available_at"),
            F.when(F.col("event_type").isin("view", "click"), F.col("ts")).alias("vintage_at"),
            "value",
            F.when(n % 53 == 0, F.array(F.lit("ARTIFACT_MISSING")))
            .when(n % 17 == 0, F.array(F.lit("STALE_BAR")))
            .otherwise(F.array().cast("array<string>"))
            .alias("quality_flags"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        return self.events.select((day + F.expr("interval 18 hours")).alias("decision_at")).distinct()

    @cached_property
    def bars(self) -> DataFrame:
        return _bars(self, "p_type")

    @cached_property
    def bars_sparse(self) -> DataFrame:
        return _bars(self, "p_brand")

    @cached_property
    def sessions(self) -> DataFrame:
        """Trading dates seen in the data with a dense index; at most one row per calendar day."""
        days = self.bars.select("session").distinct()
        return days.withColumn("idx", F.row_number().over(Window.orderBy("session")).cast("bigint"))

    @cached_property
    def actions(self) -> DataFrame:
        b = self.bars
        none = F.lit(None).cast("double")

        def part(df, kind, day, amount, ratio):
            return df.select(
                "entity_id",
                F.lit(kind).alias("kind"),
                day.alias("effective_date"),
                amount.alias("amount"),
                ratio.alias("ratio"),
            )

        div = b.select("entity_id", F.trunc("session", "quarter").alias("d")).distinct()
        split = (
            b.where(F.col("entity_id").isin("LARGE", "PROMO") & (F.col("session") >= "1998-01-01"))
            .groupBy("entity_id")
            .agg(F.min("session").alias("d"))
        )
        dead = b.where(F.col("entity_id") == "SMALL").select("entity_id").distinct()
        return (
            part(div, "CASH_DIVIDEND", F.col("d"), F.lit(100.0), none)
            .union(part(split, "SPLIT", F.col("d"), none, F.lit(2.0)))
            .union(part(dead, "DELISTING", F.lit("2001-06-29").cast("date"), F.lit(500.0), none))
        )

    @cached_property
    def fills(self) -> DataFrame:
        ent = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("entity_id"))
        # A fill on a day without a session belongs to the next one, after the last session to that; one row per day.
        days = self.lineitem.select(F.col("l_shipdate").cast("date").alias("day")).distinct()
        days = days.join(F.broadcast(self.sessions.select("session")), F.col("day") == F.col("session"), "left")
        ahead, whole = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        days = days.select("day", F.coalesce(F.first("session", ignorenulls=True).over(ahead), F.max("session").over(whole)).alias("session"))
        li = self.lineitem.withColumn("day", F.col("l_shipdate").cast("date")).join(F.broadcast(days), "day").join(ent, "l_partkey")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return li.select(
            F.concat_ws(
                "-",
                *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                cents.cast("string"),
                F.col("l_quantity").cast("bigint").cast("string"),
            ).alias("fill_id"),
            (F.col("l_suppkey") % 20).alias("account"),
            "entity_id",
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            "session",
            (F.col("l_extendedprice") * F.col("l_quantity") * 0.0001).alias("fee"),
        )


# Views on orders and customers.
ENTITIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_ENT = ", ".join(f"'{e}'" for e in ENTITIES)
SQL_VIEWS["book_orders"] = f"""
select o_orderkey as order_id, [{_ENT}][o_custkey % 6 + 1] as entity_id, cast(o_orderdate as date) as decided,
  cast(ceil(o_totalprice / 1000) as bigint) as quantity, case when o_orderstatus = 'F' then 'SELL' else 'BUY' end as side,
  o_custkey as cust from orders"""


def book_orders(t: Tables) -> DataFrame:
    ents = F.array(*[F.lit(e) for e in ENTITIES])
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.element_at(ents, (F.col("o_custkey") % 6 + 1).cast("int")).alias("entity_id"),
        F.col("o_orderdate").cast("date").alias("decided"),
        F.ceil(F.col("o_totalprice") / 1000).alias("quantity"),
        F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("o_custkey").alias("cust"),
    )
