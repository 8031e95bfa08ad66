"""Parser queries. Payloads are written by Spark from the driver tables in the feeds' own shapes
and parsed back, so that SQL over the tables can check every parsed row."""

from pyspark.sql import functions as F


from knownwhen.operators import calendars as cal
from knownwhen.operators import pit
from knownwhen.plans.catalog import query
from knownwhen.plans.dates import NY_AT, NY_DAY
from knownwhen.plans.evaluation import wf_splits
from knownwhen.plans.store import stored
from knownwhen.plans.views import SQL_VIEWS
from knownwhen.sources import actions as act
from knownwhen.sources import feeds
from knownwhen.sources.envelope import with_hash


def day_rows(t, col="l_shipdate", table="lineitem"):
    d = F.col(col).cast("date")
    return cal.day_table(getattr(t, table).agg(F.date_sub(F.min(d), 40).alias("first"), F.date_add(F.max(d), 60).alias("last")))


# ---- bars ----

SQL_VIEWS["printed"] = """
select entity_id, session, close, volume, 0 as rep from bars union all select entity_id, session, close, volume, 1 from bars where volume % 13 = 0
union all select p_type, cast(l_shipdate as date), cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / count(*), cast(sum(l_quantity) as bigint), 0
from lineitem join part on p_partkey = l_partkey where isodow(l_shipdate) > 5 group by 1, 2"""
SQL_VIEWS["printed_times"] = """
select p.*, x.session is not null as on_session, coalesce(x.close_at, n.close_at) + interval 60 minute as available_at
from printed p left join xnys x on x.session = p.session asof left join xnys n on n.session > p.session"""


def printed(t):
    b = t.bars.select("entity_id", "session", "open", "high", "low", "close", "volume", F.lit(0).alias("rep"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("entity_id"))
    px = F.col("l_extendedprice")
    w = t.lineitem.where(F.weekday("l_shipdate") > 4).join(p, "l_partkey").groupBy("entity_id", F.col("l_shipdate").cast("date").alias("session")).agg(
        (F.sum(px.cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume")
    )
    w = w.select("entity_id", "session", *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", "volume", F.lit(0).alias("rep"))
    return b.union(b.where("volume % 13 = 0").withColumn("rep", F.lit(1))).union(w)


def keyed_pages(t):
    """Pages of one year: symbols in lower case, bars stamped at New York midnight."""
    bar = F.struct(
        "session", "rep", F.concat(F.col("session").cast("string"), F.lit("T05:00:00Z")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"),
        F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"),
    )
    g = printed(t).groupBy(F.year("session").alias("y"), "entity_id").agg(F.array_sort(F.collect_list(bar)).alias("arr"))
    arr = F.transform("arr", lambda b: F.struct(b["t"].alias("t"), b["o"].alias("o"), b["h"].alias("h"), b["l"].alias("l"), b["c"].alias("c"), b["v"].alias("v")))
    page = g.withColumn("arr", arr).groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("entity_id"), "arr"))).alias("bars"))
    return with_hash(page.select(F.concat(F.lit("page-"), "y").alias("path"), F.to_json(F.struct("bars")).alias("content")))


def daily_files(t):
    """One array per symbol and year, with dividends and splits in the rows; some files are damaged."""
    v = F.col("volume")
    row = F.struct(
        "session", "rep", F.concat(F.col("session").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "open", "high", "low",
        F.when(v % 400 != 7, F.col("close")).alias("close"), "volume", F.when(v % 401 == 3, -0.1).when(v % 29 == 0, v % 100 / 100.0).otherwise(0.0).alias("divCash"),
        F.when(v % 97 == 0, 2.0).otherwise(1.0).alias("splitFactor"),
    )
    g = printed(t).groupBy(F.year("session").alias("y"), "entity_id").agg(F.array_sort(F.collect_list(row)).alias("arr"))
    names = ("date", "open", "high", "low", "close", "volume", "divCash", "splitFactor")
    arr = F.transform("arr", lambda b: F.struct(*[b[n].alias(n) for n in names]))
    return with_hash(g.select(F.concat_ws("-", "entity_id", "y").alias("path"), F.col("entity_id").alias("symbol"), F.to_json(arr).alias("content")))


@query(
    "ingest_bars_keyed_json", "source_locator:s available_at:t flags:s close:f8",
    """select concat('bars/1d/', entity_id, '/', session, case when rep = 1 then '#repeat1' else '' end) as source_locator, available_at,
         case when on_session and rep = 0 then 'AVAILABLE_AT_ESTIMATED' else 'AVAILABLE_AT_ESTIMATED,STALE_BAR' end as flags, close from printed_times""",
)
def _(t):
    good, _bad = feeds.bars_keyed(keyed_pages(t), day_rows(t))
    return good.withColumn("flags", F.array_join("quality_flags", ",")).withColumn("close", F.get_json_object("value", "$.close").cast("double"))


@query(
    "ingest_bars_array_json", "path:s status:s n:i n_stale:i",
    """with f as (select concat(entity_id, '-', year(session)) as path, count(*) filter (volume % 400 = 7) as bad, count(*) as n, count(*) filter (not on_session or rep = 1) as n_stale from printed_times group by 1)
       select path, case when bad > 0 then 'SCHEMA_DRIFT' else 'OK' end as status, case when bad = 0 then n end as n, case when bad = 0 then n_stale end as n_stale from f""",
)
def _(t):
    good, bad = feeds.bars_array(daily_files(t), day_rows(t))
    day = F.to_date(F.substring_index(F.substring_index("source_locator", "/", -1), "#", 1))
    ok = good.groupBy(F.concat_ws("-", "entity_id", F.year(day)).alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("quality_flags", "STALE_BAR")).alias("n_stale")
    )
    return ok.withColumn("status", F.lit("OK")).unionByName(bad.select("path", F.col("code").alias("status")), allowMissingColumns=True)


@query(
    "ingest_vendor_actions", "entity_id:s kind:s ex_date:d amount:f4",
    """with p as (select *, case when volume % 401 = 3 then -0.1 when volume % 29 = 0 then volume % 100 / 100.0 else 0 end as div, volume % 97 = 0 as split from printed),
         a as (select entity_id, session, 'CASH_DIVIDEND' as kind, div as amount from p where div > 0 union all select entity_id, session, 'SPLIT', 2 from p where split),
         bad as (select entity_id, year(session) as y from p where div < 0 union select entity_id, year(session) from a group by entity_id, session, kind having count(*) > 1)
       select entity_id, kind, session as ex_date, amount from a where (entity_id, year(session)) not in (select (entity_id, y) from bad)""",
)
def _(t):
    good, _bad = feeds.vendor_actions(daily_files(t))
    return good.select(
        "entity_id", F.get_json_object("value", "$.kind").alias("kind"), F.col("effective_at").alias("ex_date"), F.get_json_object("value", "$.amount").cast("double").alias("amount")
    )


# ---- action files ----

SQL_VIEWS["wide_actions"] = """
select *, ['SPLIT', 'CASH_DIVIDEND', 'SYMBOL_CHANGE', 'MERGER', 'SPINOFF', 'DELISTING', 'STALE_BAR', 'MYSTERY'][k % 8 + 1] as kind
from (select o_orderkey as id, o_custkey % 8 as k, o_orderkey as n, cast(o_orderdate as date) as d from orders)"""


@query(
    "validate_actions", "id:i kind:s problems:s",
    """select * from (select id, kind, concat_ws(',', case when kind = 'MYSTERY' then 'UNKNOWN_KIND' end, case when kind <> 'MYSTERY' and n % 11 = 0 then 'UNREAD_FIELD' end, case when kind <> 'MYSTERY' and n % 13 = 0 then 'NO_ENTITY' end,
         case when kind <> 'MYSTERY' and n % 17 = 0 then 'BAD_DATE' end, case when kind in ('SPLIT', 'SPINOFF') and n % 5 = 0 then 'BAD_RATIO' end, case when kind = 'CASH_DIVIDEND' and n % 5 = 0 then 'BAD_AMOUNT' end,
         case when kind = 'CASH_DIVIDEND' and (n % 17 = 0 or n % 7 = 0) then 'PAY_BEFORE_EX' end, case when kind = 'SYMBOL_CHANGE' and n % 3 = 0 then 'NO_SYMBOL' end, case when kind = 'MERGER' and n % 6 = 0 then 'NO_TERMS' end,
         case when kind = 'SPINOFF' and n % 3 = 0 then 'UNVALUED_SPINOFF' end, case when kind = 'MERGER' and n % 3 = 1 then 'UNVALUED_STOCK_MERGER' end, case when kind = 'DELISTING' and n % 4 = 0 then 'UNVALUED_DELISTING' end) as problems
       from wide_actions) where problems <> ''""",
)
def _(t):
    n, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kinds = F.array(*[F.lit(k) for k in (*[k for k in act.FIELDS if k != "CORRECTED_BAR"], "MYSTERY")])
    rows = t.orders.select(n.alias("id"), F.element_at(kinds, (F.col("o_custkey") % 8 + 1).cast("int")).alias("kind"), n.alias("n"), d.alias("d"))
    n, kind = F.col("n"), F.col("kind")
    day = F.when(n % 17 == 0, "soon").otherwise(F.col("d").cast("string"))
    who = F.when(n % 13 != 0, F.lit("E1"))

    def only(cond, key, value):
        return F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value")))

    ratio = F.when(n % 5 == 0, "0").otherwise("2.5")
    pairs = F.array_compact(
        F.array(
            only(kind.isNotNull(), "kind", kind),
            only(kind == "SPINOFF", "parent", who),
            only(kind != "SPINOFF", "entityId", who),
            only(kind.isin("SPLIT", "CASH_DIVIDEND", "SPINOFF"), "exDate", day),
            only(kind.isin("SYMBOL_CHANGE", "MERGER"), "effective", day),
            only(kind == "DELISTING", "lastTradeDate", day),
            only(kind == "STALE_BAR", "session", day),
            only(kind.isin("SPLIT", "SPINOFF"), "ratio", ratio),
            only(kind == "CASH_DIVIDEND", "amount", F.when(n % 5 == 0, "-1").otherwise("0.25")),
            only(kind == "CASH_DIVIDEND", "payDate", F.date_add("d", F.when(n % 7 == 0, -1).otherwise(3)).cast("string")),
            only(kind == "SYMBOL_CHANGE", "oldSymbol", F.lit("A")),
            only((kind == "SYMBOL_CHANGE") & (n % 3 != 0), "newSymbol", F.lit("B")),
            only((kind == "MERGER") & (n % 3 == 1), "terms.stockRatio", F.lit("0.5")),
            only((kind == "MERGER") & (n % 6 != 0) & (n % 3 != 1), "terms.cashPerShare", F.lit("9")),
            only((kind == "SPINOFF") & (n % 3 != 0), "childFirstClose", F.lit("30")),
            only((kind == "DELISTING") & (n % 4 != 0), "finalPrice", F.lit("0")),
            only(n % 11 == 0, "childFirstclose", F.lit("30")),
        )
    )
    rows = rows.withColumn("action", F.map_from_entries(pairs))
    out = act.validate_actions(rows).where(F.size("problems") > 0)
    return out.withColumn("problems", F.array_join("problems", ","))


SQL_VIEWS["signed_rows"] = """
select brand, b, q, n, n % 100 / 100.0 as amount from (select p_brand as brand, cast(replace(p_brand, 'Brand#', '') as int) as b, cast(date_trunc('quarter', l_shipdate) as date) as q, count(*) as n
  from lineitem join part on p_partkey = l_partkey group by 1, 2, 3)"""


def signed_files(t):
    """A signed file of dividends per brand; a few are unsigned, changed, ended twice or paid too early."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    g = t.lineitem.join(p, "l_partkey").groupBy("brand", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    b = F.replace("brand", F.lit("Brand#"), F.lit("")).cast("int")
    early = (b % 9 == 4) & (F.quarter("q") == 1)
    action = F.create_map(
        F.lit("kind"), F.lit("CASH_DIVIDEND"), F.lit("entityId"), F.col("brand"), F.lit("amount"), (F.col("n") % 100 / 100).cast("decimal(10,2)").cast("string"),
        F.lit("exDate"), F.col("q").cast("string"), F.lit("payDate"), F.date_add("q", F.when(early, -2).otherwise(5)).cast("string"), F.lit("qualified"), F.lit("false"),
    )
    announced = F.concat(F.date_add("q", F.when(F.quarter("q") % 2 == 0, -3).otherwise(2)).cast("string"), F.lit("T12:00:00Z"))
    sources = F.when(F.quarter("q") == 3, F.array(F.lit("issuer:a"), F.lit("issuer:a"))).otherwise(F.array(F.lit("issuer:a"), F.lit("exchange:b")))
    entry = F.struct("q", action.alias("action"), announced.alias("announcedAt"), sources.alias("sources"))
    f = g.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("q", "n")), None).alias("_o"), F.collect_list(entry).alias("es"))
    f = f.withColumn("es", F.array_sort("es", lambda x, y: F.when(x["q"] < y["q"], -1).when(x["q"] > y["q"], 1).otherwise(0)))
    none = F.lit(None).cast("string")
    dead = F.create_map(F.lit("kind"), F.lit("DELISTING"), F.lit("entityId"), F.col("brand"), F.lit("lastTradeDate"), F.lit("2000-06-30"), F.lit("reason"), F.lit("x"), F.lit("finalPrice"), F.lit("1"))
    end = F.struct(dead.alias("action"), none.alias("announcedAt"), F.array(F.lit("issuer:a"), F.lit("exchange:b")).alias("sources"))
    es = F.transform("es", lambda e: F.struct(e["action"].alias("action"), e["announcedAt"].alias("announcedAt"), e["sources"].alias("sources")))
    es = F.when(b % 6 == 3, F.concat(es, F.array(end))).otherwise(es)
    f = f.withColumn("es", es).withColumn("hash", act.actions_hash(F.col("es")))
    approval = F.struct(
        F.when(b % 8 != 5, "owner").alias("approvedBy"), F.when(b % 10 == 7, "2030-01-01T00:00:00Z").otherwise("2020-01-01T00:00:00Z").alias("approvedAt"),
        F.when(b % 11 == 8, F.reverse("hash")).otherwise(F.col("hash")).alias("actionsHash"),
    )
    return with_hash(f.select(F.col("brand").alias("path"), F.to_json(F.struct(F.col("brand").alias("dataset"), approval.alias("approval"), F.col("es").alias("actions"))).alias("content")))


_BADFILE = "(b % 8 = 5 or b % 10 = 7 or b % 11 = 8 or b % 6 = 3 or (b % 9 = 4 and exists (select 1 from signed_rows x where x.brand = s.brand and quarter(q) = 1)))"


@query(
    "ingest_reconciled_actions", "source_locator:s available_at:t flags:s",
    f"""select concat_ws('/', 'vendor/corporate-actions', brand, brand, 'CASH_DIVIDEND', q) as source_locator,
         cast(q as timestamp) + case when quarter(q) % 2 = 0 then interval 0 hour else interval 60 hour end as available_at, case when quarter(q) = 3 then 'UNVERIFIED_SINGLE_SOURCE' else '' end as flags
       from signed_rows s where not {_BADFILE}""",
)
def _(t):
    good, _bad = act.reconciled_file(signed_files(t), F.lit("2024-01-01").cast("timestamp_ntz"))
    return good.withColumn("flags", F.array_join("quality_flags", ","))


@query(
    "refused_action_files", "path:s problems:s",
    """select * from (select brand as path, concat_ws(',', case when b % 6 = 3 and max(q) > date '2000-06-30' then 'AFTER_SERIES_END' end, case when b % 10 = 7 then 'APPROVED_AFTER_INGEST' end, case when b % 11 = 8 then 'CHANGED_AFTER_APPROVAL' end,
         case when b % 9 = 4 and bool_or(quarter(q) = 1) then 'PAY_BEFORE_EX' end, case when b % 8 = 5 then 'UNSIGNED' end) as problems from signed_rows group by brand, b) where problems <> ''""",
)
def _(t):
    _good, bad = act.reconciled_file(signed_files(t), F.lit("2024-01-01").cast("timestamp_ntz"))
    return bad.withColumn("problems", F.array_join("problems", ","))


@query(
    "ingest_curated_csv", "line:i problems:s",
    """with r as (select o_orderkey as line, o_custkey as c, o_orderkey as n, case when o_orderkey % 6 = 0 then 'SPLIT' when o_orderkey % 41 = 0 then 'GIFT' else 'CASH_DIVIDEND' end as kind, cast(date_trunc('quarter', o_orderdate) as date) as ex from orders),
         p as (select *, concat_ws(',', case when n % 19 = 0 then 'BAD_SOURCE' end, case when n % 19 <> 0 and c % 37 = 0 then 'RESERVED_SOURCE' end, case when n % 23 = 0 then 'BAD_ENTITY' end, case when kind = 'GIFT' then 'BAD_KIND' end,
             case when n % 29 = 0 then 'BAD_EX_DATE' end, case when n % 31 = 0 then 'BAD_VALUE' end, case when kind = 'SPLIT' and n % 4 = 0 then 'SPLIT_HAS_PAY_DATE' end,
             case when kind <> 'SPLIT' and n % 29 <> 0 and n % 4 = 0 and n % 43 = 0 then 'PAY_BEFORE_EX' end, case when n % 47 = 0 then 'NO_DOCUMENT' end) as own from r),
         k as (select *, case when own = '' then row_number() over (partition by own = '', c % 37, chr(65 + cast(c % 26 as int)), kind, ex order by line) end as rk from p)
       select line, case when own <> '' then own else 'DUPLICATE' end as problems from k where own <> '' or rk > 1""",
)
def _(t):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    ex = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    kind = F.when(n % 6 == 0, "SPLIT").when(n % 41 == 0, "GIFT").otherwise("CASH_DIVIDEND")
    rows = t.orders.select(
        n.alias("line"), F.when(n % 19 == 0, "Reuters").when(c % 37 == 0, "issuer:feed").otherwise(F.concat(F.lit("issuer:doc-"), c % 37)).alias("source"),
        F.when(n % 23 == 0, "9X").otherwise(F.lower(F.char((c % 26 + 65).cast("int")))).alias("entity"), kind.alias("kind"), F.when(n % 29 == 0, "03/04/2010").otherwise(ex.cast("string")).alias("ex_date"),
        F.when(n % 31 == 0, "-0.5").otherwise("0.25").alias("value"), F.when(n % 4 == 0, F.date_add(ex, F.when(n % 43 == 0, -3).otherwise(3)).cast("string")).alias("pay_date"), F.when(n % 47 == 0, " ").otherwise("p. 14, table").alias("document"),
    )
    out = act.curated_problems(rows, ("issuer:feed",)).where(F.size("problems") > 0)
    return out.withColumn("problems", F.array_join("problems", ","))


@query(
    "ingest_structural", "entity_id:s kind:s ex_date:d last_date:d source:s selected_kind:s selected_date:d choice:s",
    """with s as (select *, case kind when 'SPINOFF' then 'SPLIT' else 'CASH_DIVIDEND' end as sk from structural)
       select entity_id, kind, ex_date, last_date, 'src0' as source, sk as selected_kind, ex_date as selected_date, 'supersedes' as choice from s
       union all select entity_id, kind, ex_date, last_date, 'src1', sk, cast(ex_date + interval 1 month as date), 'keeps' from s""",
)
def _(t):
    from knownwhen.plans.agreement import structural

    s = structural(t)
    spin, merge = F.col("kind") == "SPINOFF", F.col("kind") == "MERGER"

    def kv(cond, k, v):
        return F.when(cond, F.struct(F.lit(k).alias("key"), v.alias("value")))

    day = F.col("ex_date").cast("string")
    action = F.map_from_entries(
        F.array_compact(
            F.array(
                kv(F.lit(True), "kind", F.col("kind")), kv(spin, "parent", F.col("entity_id")), kv(~spin, "entityId", F.col("entity_id")), kv(spin, "exDate", day), kv(merge, "effective", day),
                kv(F.col("kind") == "DELISTING", "lastTradeDate", day), kv(merge, "terms.cashPerShare", F.lit("5")),
            )
        )
    )
    k = F.when(spin, "SPLIT").otherwise("CASH_DIVIDEND")
    sup = F.array(F.struct(F.lit("src0").alias("source"), k.alias("kind"), F.lit(None).cast("string").alias("exDate")))
    keep = F.array(F.struct(F.lit("src1").alias("source"), k.alias("kind"), F.add_months("ex_date", 1).cast("string").alias("exDate")))
    doc = F.struct(F.array(F.struct(action.alias("action"), F.array(F.lit("issuer:a")).alias("sources"), sup.alias("supersedes"), keep.alias("keeps"))).alias("actions"))
    entries, selectors = act.structural_entries(s.select(F.col("entity_id").alias("path"), F.to_json(doc).alias("content")))
    sel = selectors.select("entity_id", "source", F.col("kind").alias("selected_kind"), F.col("ex_date").alias("selected_date"), "choice")
    return entries.select("entity_id", "kind", "ex_date", "last_date").join(sel, "entity_id")


SQL_VIEWS["dist_rows"] = """
select p_brand as entity_id, cast(date_trunc('month', l_shipdate) as date) as ex_date, concat('c', l_linenumber % 6) as component, (sum(cast(round(l_discount * 100) as bigint)) - 2) % 20 / 100.0 as amount,
  cast(date_trunc('month', l_shipdate) as date) + cast(count(*) * 7 % 11 - 4 as int) as pay_date from lineitem join part on p_partkey = l_partkey group by p_brand, date_trunc('month', l_shipdate), l_linenumber"""


def dist_rows(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    m = F.trunc(F.col("l_shipdate").cast("date"), "month").alias("ex_date")
    g = t.lineitem.join(p, "l_partkey").groupBy("entity_id", m, "l_linenumber").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        "entity_id", "ex_date", F.concat(F.lit("c"), F.col("l_linenumber") % 6).alias("component"), ((F.col("c") - 2) % 20 / 100).cast("decimal(10,2)").alias("amount"),
        F.date_add("ex_date", (F.col("n") * 7 % 11 - 4).cast("int")).alias("pay_date"),
    )


@query(
    "issuer_distributions_by_ex_date", "entity_id:s ex_date:d amount:f4 pay_date:d components:i",
    """with g as (select entity_id, ex_date, sum(amount) as amount, max(pay_date) as pay, count(distinct component) as components, count(*) as n from dist_rows group by 1, 2)
       select entity_id, ex_date, amount, case when pay >= ex_date then pay end as pay_date, components from g where n = components and abs(amount) > 0.001""",
)
def _(t):
    return act.distributions_by_ex_date(dist_rows(t))[0]


@query(
    "duplicate_distribution_components", "entity_id:s ex_date:d component:s n:i",
    "select entity_id, ex_date, component, count(*) as n from dist_rows group by 1, 2, 3 having count(*) > 1",
)
def _(t):
    return act.distributions_by_ex_date(dist_rows(t))[1]


SQL_VIEWS["nav_history"] = """
select entity_id, session, (50 + volume % 7) / f as nav, 1000.0 * f as shares from (select *, case when session >= date '2000-03-01' then 6.0 when session >= date '1998-06-01' then 2.0 else 1.0 end as f from bars)"""
_RATIOS = ", ".join(str(r) for r in act.STANDARD_RATIOS)


@query(
    "split_detect_from_nav", "entity_id:s previous:d session:d finding:s ratio:f4 sessions_missing:i",
    f"""with c as (select *, lag(session) over w as previous, lag(nav) over w as pn, lag(shares) over w as ps from nav_history window w as (partition by entity_id order by session)),
         i as (select day, is_session, count(*) filter (is_session) over (order by day) as k from cal_days),
         x as (select c.*, pn / nav as nr, shares / ps as sr, b.k - a.k - case when b.is_session then 1 else 0 end as sessions_missing, a.is_session and b.is_session as adjacent from c join i a on a.day = previous join i b on b.day = c.session),
         y as (select *, not (nr < 1.25 and nr > 0.8) as jump, case when sessions_missing = 0 and adjacent then list_filter([{_RATIOS}], lambda r: abs(nr / r - 1) <= 0.15 and abs(sr / r - 1) <= 0.05) end as hits from x)
       select * from (select entity_id, previous, session, case when jump and len(hits) = 1 then 'SPLIT' when jump then 'JUMP' when sessions_missing > 0 then 'GAP' end as finding, case when jump and len(hits) = 1 then hits[1] end as ratio, sessions_missing from y)
       where finding is not null""",
)
def _(t):
    d = F.col("session")
    f = F.when(d >= "2000-03-01", 6.0).when(d >= "1998-06-01", 2.0).otherwise(1.0)
    nav = t.bars.select("entity_id", "session", ((F.col("volume") % 7 + 50) / f).alias("nav"), (f * 1000.0).alias("shares"))
    return act.split_detect(nav, day_rows(t))


# ---- other feeds ----


@query(
    "ingest_macro_vintages", "entity_id:s effective_at:d vintage_at:d available_at:t value:f2",
    f"""select concat('S', substr(o_orderpriority, 1, 1)) as entity_id, date_trunc('month', o_orderdate) as effective_at, o_orderdate as vintage_at, {NY_AT.format('cast(o_orderdate as date)', 510)} as available_at,
         case when o_orderkey % 17 <> 0 then o_totalprice end as value from orders""",
)
def _(t):
    d = F.col("o_orderdate").cast("date")
    month, vintage = F.trunc(d, "month").cast("string"), d.cast("string")
    o = F.struct(
        vintage.alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), month.alias("date"),
        F.when(F.col("o_orderkey") % 17 == 0, ".").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value"),
    )
    series = F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("series")
    # A page holds the observations of at most a thousand order keys.
    page = F.floor(F.col("o_orderkey") / 1000).alias("page")
    g = t.orders.groupBy(series, page).agg(F.collect_list(o).alias("observations"))
    doc = F.to_json(F.struct(F.lit("1990-01-01").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), "observations"))
    good, _bad = feeds.macro_vintages(with_hash(g.select(F.concat_ws("-", "series", "page").alias("path"), "series", doc.alias("content"))))
    return good


@query(
    "vintage_windows", "series:s window_no:i start:d end_date:d n:i shares_boundary:b",
    """with d as (select distinct o_orderpriority as series, cast(o_orderdate as date) as v from orders), r as (select *, row_number() over (partition by series order by v) - 1 as i, count(*) over (partition by series) as n from d),
         w as (select distinct series, k as window_no, n from r, lateral (select unnest(range(greatest(1, cast(ceil((n - 1) / 99.0) as bigint)))) as k))
       select w.series, window_no, min(v) as start, max(v) as end_date, count(*) as n, window_no > 0 as shares_boundary from w join r on r.series = w.series and i between window_no * 99 and window_no * 99 + 99 group by 1, 2""",
)
def _(t):
    d = t.orders.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("vintage"))
    return feeds.vintage_windows(d, 100, "series").withColumnRenamed("end", "end_date")


@query(
    "ingest_positions_wide", "entity_id:s report:d figure:s amount:f4 available_at:t",
    f"""with r as (select p_brand as entity_id, cast(l_shipdate as date) as report, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem join part on p_partkey = l_partkey group by 1, 2),
         d as (select *, report + cast((9 - isodow(report)) % 7 as int) as tue from (select distinct report from r)),
         h as (select *, (select bool_or(fed) from cal_days where day between tue and tue + 3) as delayed from d),
         a as (select report, case when delayed then {NY_AT.format("(select min(day) from cal_days where day >= tue + 6 and isodow(day) <= 5 and not fed)", 930)} else {NY_AT.format("tue + 3", 930)} end as available_at from h),
         f as (select entity_id, report, 'open_interest_all' as figure, n as amount from r union all select entity_id, report, 'comm_positions_long_all', q from r union all select entity_id, report, 'pct_of_oi', n / 4.0 from r where n % 2 = 0)
       select * from f join a using (report)""",
)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("market"))
    g = t.lineitem.join(p, "l_partkey").groupBy("market", F.col("l_shipdate").cast("date").alias("report")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q")
    )
    row = F.create_map(
        F.lit("report_date_as_yyyy_mm_dd"), F.concat(F.col("report").cast("string"), F.lit("T00:00:00.000")), F.lit("cftc_contract_market_code"), F.concat(F.lit(" "), "market"),
        F.lit("commodity_name"), F.lit("Widgets"), F.lit("open_interest_all"), F.col("n").cast("string"), F.lit("comm_positions_long_all"), F.col("q").cast("string"),
        F.lit("pct_of_oi"), F.when(F.col("n") % 2 == 0, (F.col("n") / 4).cast("string")).otherwise(""),
    )
    f = g.groupBy("market", F.trunc("report", "month").alias("m")).agg(F.to_json(F.collect_list(row)).alias("content"))
    good, _bad = feeds.positions_wide(with_hash(f.select(F.concat_ws("-", "market", "m").alias("path"), "content")), "legacy")
    return feeds.positions_long(good).withColumnRenamed("effective_at", "report")


_FORMS = "['4', '10-Q', '8-K', '4/A', 'DEF 14A'][cast(substr(o_orderpriority, 1, 1) as int)]"
SQL_VIEWS["filings"] = f"""
select o_orderkey as k, o_custkey as c, {_FORMS} as form, cast(o_orderdate as date) as filed, case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 9 - 4 as int) end as report,
  o_orderdate + to_hours(cast(o_orderkey % 24 as int)) as accepted from orders"""
SQL_VIEWS["filing_times"] = f"""
select f.*, x.is_session and accepted <= {NY_AT.format('x.day', 1050)} as same, (select min(session) from xnys where session > x.day) as nxt from filings f join cal_days x on x.day = {NY_DAY.format('accepted')}"""


@query(
    "ingest_filing_index", "source_id:s source_locator:s observed_at:d available_at:t flags:s",
    f"""with g as (select *, concat('A', k) as loc, case when same then accepted else {NY_AT.format('nxt', 360)} end as av, coalesce(report > filed, false) as ahead from filing_times where c % 50 <> 7)
       select 'sec.edgar.submissions' as source_id, loc as source_locator, case when ahead then filed else report end as observed_at, av as available_at,
         concat_ws(',', case when not same then 'AFTER_HOURS_ACCEPTANCE' end, case when form like '%/A' then 'AMENDED' end, case when ahead then 'FORWARD_DATED_REPORT' end) as flags from g
       union all select 'sec.edgar.form4', loc, filed, av, concat_ws(',', case when not same then 'AFTER_HOURS_ACCEPTANCE' end, case when form like '%/A' then 'AMENDED' end) from g where form in ('4', '4/A')""",
)
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    forms = F.array(*[F.lit(x) for x in ("4", "10-Q", "8-K", "4/A", "DEF 14A")])
    f = t.orders.select(
        F.col("o_custkey").alias("c"), k.alias("k"), F.element_at(forms, F.substring("o_orderpriority", 1, 1).cast("int")).alias("form"), d.cast("string").alias("filed"),
        F.when(k % 10 == 0, "").otherwise(F.date_add(d, (k % 9 - 4).cast("int")).cast("string")).alias("report"),
        F.date_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("accepted"),
    )
    # A filer with very many filings is served in several pages.
    page = F.floor(F.col("k") / 10000).alias("page")
    g = f.groupBy("c", page).agg(F.array_sort(F.collect_list(F.struct("k", "form", "filed", "report", "accepted"))).alias("a"))
    report = F.when(F.col("c") % 50 == 7, F.concat(F.col("a.report"), F.array(F.lit("")))).otherwise(F.col("a.report"))
    recent = F.struct(
        F.transform("a.k", lambda x: F.concat(F.lit("A"), x)).alias("accessionNumber"), F.col("a.filed").alias("filingDate"), report.alias("reportDate"),
        F.col("a.accepted").alias("acceptanceDateTime"), F.col("a.form").alias("form"),
    )
    doc = F.to_json(F.struct(F.col("c").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings")))
    good, _bad = feeds.filing_index(with_hash(g.select(F.concat_ws("-", F.lit("cik"), "c", "page").alias("path"), doc.alias("content"))), day_rows(t, "o_orderdate", "orders"))
    return good.withColumn("flags", F.array_join("quality_flags", ","))


@query(
    "ingest_form4_xml", "source_locator:s entity_id:s observed_at:d available_at:t flags:s shares:f2 is10b51:s owner:s",
    f"""with o as (select f.*, same, nxt from filing_times f where form in ('4', '4/A')),
         l as (select l_orderkey as k, l_quantity as q, l_linenumber as ln, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as pos from lineitem),
         x as (select o.*, pos, q, filed - cast(ln % 5 as int) as traded, case when ln % 3 = 0 then 'true' when k % 2 = 0 then 'false' end as plan, accepted > {NY_AT.format("(select session from xnys z where z.idx = (select max(idx) from xnys y where y.session <= filed - cast(ln % 5 as int)) + 2)", 1320)} as late
           from o join l using (k))
       select concat('A', k, '/nonDerivativeTransaction/', pos) as source_locator, concat('CIK', lpad(cast(c as varchar), 10, '0')) as entity_id, traded as observed_at, case when same then accepted else {NY_AT.format('nxt', 360)} end as available_at,
         concat_ws(',', case when not same then 'AFTER_HOURS_ACCEPTANCE' end, case when form like '%/A' then 'AMENDED' end, case when late then 'LATE_FILING' end) as flags, q as shares, plan as is10b51, lpad(cast(70 + k % 9 as varchar), 10, '0') as owner from x""",
)
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    forms = F.array(*[F.lit(x) for x in ("4", "10-Q", "8-K", "4/A", "DEF 14A")])
    o = t.orders.select(
        k.alias("k"), F.col("o_custkey").alias("c"), F.element_at(forms, F.substring("o_orderpriority", 1, 1).cast("int")).alias("form"), d.alias("filed"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("accepted"),
    ).where("form in ('4', '4/A')")
    li = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("s")
    )
    g = o.join(li, "k").groupBy("k", "c", "form", "filed", "accepted").agg(F.array_sort(F.collect_list("s")).alias("rows"))

    def el(name, text):
        return F.concat(F.lit(f"<{name}><value>"), text, F.lit(f"</value></{name}>"))

    def tx(s):
        plan = F.when(s["l_linenumber"] % 3 == 0, "<aff10b5One>1</aff10b5One>").otherwise("")
        return F.concat(
            F.lit("<nonDerivativeTransaction>"), el("securityTitle", F.lit("Common")), el("transactionDate", F.date_sub("filed", s["l_linenumber"] % 5).cast("string")),
            F.lit("<transactionCoding><transactionCode>P</transactionCode></transactionCoding>"), plan, F.lit("<transactionAmounts>"), el("transactionShares", s["l_quantity"].cast("string")),
            el("transactionPricePerShare", s["l_extendedprice"].cast("string")), el("transactionAcquiredDisposedCode", F.lit("A")), F.lit("</transactionAmounts></nonDerivativeTransaction>"),
        )

    body = F.array_join(F.transform("rows", tx), "")
    doc_plan = F.when(F.col("k") % 2 == 0, "<aff10b5One>0</aff10b5One>").otherwise("")
    joint = F.when(F.col("k") % 3 == 0, "<reportingOwner><reportingOwnerId><rptOwnerCik>88</rptOwnerCik></reportingOwnerId></reportingOwner>").otherwise("")
    xml = F.concat(
        F.lit("<?xml version=\"1.0\"?><ownershipDocument>"), doc_plan, F.lit("<issuer><issuerCik>"), F.col("c"), F.lit("</issuerCik><issuerTradingSymbol>W</issuerTradingSymbol></issuer>"),
        F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), (70 + F.col("k") % 9).cast("string"), F.lit("</rptOwnerCik></reportingOwnerId></reportingOwner>"), joint, F.lit("<nonDerivativeTable>"), body, F.lit("</nonDerivativeTable></ownershipDocument>"),
    )
    docs = with_hash(g.select(F.concat(F.lit("f4-"), "k").alias("path"), F.concat(F.lit("A"), "k").alias("accession"), "accepted", "form", xml.alias("content")))
    good, _bad = feeds.form4_xml(docs, day_rows(t, "o_orderdate", "orders"))
    return good.select(
        "source_locator", "entity_id", "observed_at", "available_at", F.array_join("quality_flags", ",").alias("flags"), F.get_json_object("value", "$.shares").cast("double").alias("shares"),
        F.get_json_object("value", "$.is10b51").alias("is10b51"), F.get_json_object("value", "$.owner").alias("owner"),
    )


@query(
    "ingest_holdings", "source_id:s source_locator:s n_lines:i weight:f6",
    """select concat('etf_holdings.', lower(p_brand)) as source_id, concat('holdings/', p_brand, '/2024-01-', lpad(cast(p_size % 28 + 1 as varchar), 2, '0')) as source_locator, count(*) as n_lines, sum(cast(p_retailprice as decimal(18, 2))) / 1000 as weight from part group by 1, 2""",
)
def _(t):
    lines = t.part.select(
        F.col("p_brand").alias("fund"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 28).cast("int")).alias("as_of"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("symbol"),
        (F.col("p_retailprice").cast("decimal(18,2)") / 1000).cast("decimal(18,8)").alias("weight"), F.lit("2024-02-01 12:00:00").cast("timestamp_ntz").alias("fetched_at"), F.lit("sha256:0").alias("raw_content_hash"),
    )
    out = feeds.holdings(lines)
    doc = F.from_json("value", "lines array<struct<symbol:string,weight:decimal(18,8)>>")
    return out.withColumn("n_lines", F.size(doc["lines"])).withColumn(
        "weight", F.aggregate(doc["lines"], F.lit(0.0), lambda a, x: a + x["weight"].cast("double"))
    )


@query(
    "ingest_summary", "run:d observations:i deduplicated:i conflicts:i artifacts:i sources:s",
    """with ranked as (select b.*, cast(ts as date) as run, min(id) over (partition by ident, value_hash) as first_id, min(id) over (partition by ident) as origin from stored_obs b)
       select run, count(*) as observations, count(*) filter (id > first_id) as deduplicated, count(*) filter (id <= first_id and first_id > origin) as conflicts, count(distinct raw_content_hash) as artifacts,
         string_agg(distinct event_type, ',' order by event_type) as sources from ranked group by 1""",
)
def _(t):
    rows = stored(t).withColumn("run", F.col("available_at").cast("date"))
    out = feeds.ingest_summary(pit.append_outcome(rows, rows.where(F.lit(False))))
    return out.withColumn("sources", F.array_join("sources", ","))


@query(
    "artifact_verify", "path:s status:s bytes:i",
    """select cast(doc_id as varchar) as path, case when doc_id % 89 = 0 then 'MISSING' when doc_id % 83 = 0 then 'UNREGISTERED' when doc_id % 97 = 0 then 'MISMATCH' else 'OK' end as status,
         case when doc_id % 89 <> 0 then octet_length(encode(text)) end as bytes from documents where not (doc_id % 89 = 0 and doc_id % 83 = 0)""",
)
def _(t):
    n = F.col("doc_id")
    files = t.documents.where(n % 89 != 0).select(n.cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    good = F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256))
    manifest = t.documents.where(n % 83 != 0).select(n.cast("string").alias("path"), F.when(n % 97 == 0, F.lit("sha256:bad")).otherwise(good).alias("raw_content_hash"))
    return feeds.artifact_verify(files, manifest)


@query(
    "universe_ingest_span", "entity_id:s from_date:d to_date:d",
    "select distinct p_type as entity_id, (select min(eval_start) from wf_splits) - 1095 as from_date, (select max(eval_end) from wf_splits) as to_date from part",
)
def _(t):
    return feeds.ingest_span(wf_splits(t), t.part.select(F.col("p_type").alias("entity_id")))
