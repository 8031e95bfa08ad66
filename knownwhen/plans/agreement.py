"""Corporate-action reconciliation queries."""

from decimal import Decimal

from pyspark.sql import functions as F

from knownwhen.operators import reconcile as rec
from knownwhen.plans.catalog import query
from knownwhen.plans.views import SQL_VIEWS

PREFERRED = ("src1", "src0")
TOLERANCE = Decimal("0.01")
SOURCES = ("src0", "src1", "src2")
WINDOWS = (("1995-06-01", "1998-05-31"), ("1999-01-01", "2001-06-30"))

SQL_VIEWS["source_actions"] = """
select p_brand as entity_id, case when month(l_shipdate) = 7 then 'SPLIT' else 'CASH_DIVIDEND' end as kind,
  cast(date_trunc('month', l_shipdate) as date) + case when l_suppkey % 3 = 2 and month(l_shipdate) % 4 = 0 then 3 else 0 end as ex_date,
  concat('src', l_suppkey % 3) as source,
  cast((sum(cast(round(l_discount * 100) as bigint)) // count(*)) / 100.0 as decimal(18, 6)) as value
from lineitem join part on p_partkey = l_partkey
group by p_brand, date_trunc('month', l_shipdate), month(l_shipdate), l_suppkey % 3"""
SQL_VIEWS["structural"] = """
select entity_id, kind, ex_date, case kind when 'DELISTING' then ex_date when 'MERGER' then ex_date - 1 end as last_date from (
  select p_brand as entity_id, ['DELISTING', 'SPINOFF', 'MERGER'][min(p_partkey) % 3 + 1] as kind,
    cast(date '1999-01-01' + to_months(cast(min(p_partkey) % 24 as int)) as date) as ex_date from part group by 1)"""
SQL_VIEWS["classified"] = """
select *, case when not past_end and not on_day then 'in_scope'
    when source = 'src0' and (on_day or year(ex_date) = year(last_date)) then 'set_aside'
    when source = 'src1' and on_day then 'kept' else 'unclassified' end as status
from (select r.*, s.last_date, coalesce(r.ex_date > s.last_date, false) as past_end, coalesce(r.ex_date = s.ex_date, false) as on_day
  from source_actions r left join structural s on s.entity_id = r.entity_id)"""
SQL_VIEWS["reconciled"] = """
select c.*, (select count(*) from source_actions r where r.entity_id = c.entity_id and r.kind = c.kind and r.ex_date = c.ex_date) as n_present,
  (select string_agg(source, ',' order by source) from source_actions r where r.entity_id = c.entity_id and r.kind = c.kind
    and r.ex_date = c.ex_date and case when c.kind = 'SPLIT' then r.value = chosen_value else abs(r.value - chosen_value) <= 0.01 end) as agreeing
from (select entity_id, kind, ex_date, source as chosen, value as chosen_value from source_actions
  qualify row_number() over (partition by entity_id, kind, ex_date
    order by case source when 'src1' then 1 when 'src0' then 2 else 3 end, source) = 1) c"""
_FINDING = "(strpos(agreeing, ',') = 0 or len(string_split(agreeing, ',')) < n_present)"


def source_actions(t):
    li = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id")), "l_partkey")
    src, day = F.col("l_suppkey") % 3, F.col("l_shipdate").cast("date")
    g = li.groupBy("entity_id", F.trunc(day, "month").alias("m"), src.alias("s")).agg(
        F.floor(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count(F.lit(1))).alias("cents")
    )
    shift = F.when((F.col("s") == 2) & (F.month("m") % 4 == 0), 3).otherwise(0)
    return g.select(
        "entity_id",
        F.when(F.month("m") == 7, "SPLIT").otherwise("CASH_DIVIDEND").alias("kind"),
        F.date_add("m", shift).alias("ex_date"),
        F.concat(F.lit("src"), "s").alias("source"),
        (F.col("cents") / 100).cast("decimal(18,6)").alias("value"),
    )


def structural(t):
    g = t.part.groupBy(F.col("p_brand").alias("entity_id")).agg(F.min("p_partkey").alias("k"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DELISTING", "SPINOFF", "MERGER")]), (F.col("k") % 3 + 1).cast("int"))
    day = F.add_months(F.lit("1999-01-01").cast("date"), (F.col("k") % 24).cast("int"))
    out = g.select("entity_id", kind.alias("kind"), day.alias("ex_date"))
    last = F.when(F.col("kind") == "DELISTING", F.col("ex_date")).when(F.col("kind") == "MERGER", F.date_sub("ex_date", 1))
    return out.withColumn("last_date", last)


def selectors(t, records, struct):
    s = struct.select("entity_id", F.col("ex_date").alias("day"), "last_date")
    j = records.join(s, "entity_id")
    on_day = F.col("ex_date") == F.col("day")
    sup = (F.col("source") == "src0") & (on_day | (F.year("ex_date") == F.year("last_date")))
    keep = (F.col("source") == "src1") & on_day
    return j.where(sup | keep).select(
        "entity_id", "source", "kind", "ex_date", F.when(sup, "supersedes").otherwise("keeps").alias("choice")
    )


def classified(t):
    records, struct = source_actions(t), structural(t)
    return rec.classify(records, struct, selectors(t, records, struct))


def reconciled(t):
    return rec.reconcile(source_actions(t), PREFERRED, TOLERANCE).withColumn("agreeing_text", F.array_join("agreeing", ","))


@query(
    "reconcile_actions",
    "entity_id:s kind:s ex_date:d chosen:s chosen_value:f6 agreeing_text:s verified:b",
    """select entity_id, kind, ex_date, chosen, chosen_value, agreeing as agreeing_text, strpos(agreeing, ',') > 0 as verified
       from reconciled""",
)
def _(t):
    return reconciled(t)


_VALUES = """(select string_agg(concat(source, '=', cast(value as varchar)), ';' order by source) from source_actions r
  where r.entity_id = c.entity_id and r.kind = c.kind and r.ex_date = c.ex_date)"""


def _values(df):
    shown = F.transform("values", lambda v: F.concat(v["source"], F.lit("="), v["value"].cast("string")))
    return df.withColumn("shown", F.array_join(shown, ";"))


@query(
    "disagreements",
    "entity_id:s kind:s ex_date:d chosen:s shown:s",
    f"select entity_id, kind, ex_date, chosen, {_VALUES} as shown from reconciled c where n_present >= 2 and {_FINDING}",
)
def _(t):
    return _values(rec.disagreements(reconciled(t)))


@query(
    "one_sided",
    "entity_id:s kind:s ex_date:d chosen:s shown:s",
    f"select entity_id, kind, ex_date, chosen, {_VALUES} as shown from reconciled c where n_present = 1 and {_FINDING}",
)
def _(t):
    return _values(rec.one_sided(reconciled(t)))


@query(
    "near_matches",
    "entity_id:s kind:s ex_date:d near_source:s near_date:d near_value:f6",
    f"""select c.entity_id, c.kind, c.ex_date, r.source as near_source, r.ex_date as near_date, r.value as near_value
        from reconciled c join source_actions r on r.entity_id = c.entity_id and r.kind = c.kind and r.ex_date <> c.ex_date
         and abs(r.ex_date - c.ex_date) <= 5 where {_FINDING} and not exists (select 1 from source_actions p
          where p.entity_id = c.entity_id and p.kind = c.kind and p.ex_date = c.ex_date and p.source = r.source)""",
)
def _(t):
    return rec.near_matches(reconciled(t), source_actions(t))


@query(
    "set_aside",
    "entity_id:s source:s kind:s ex_date:d status:s value:f6",
    "select entity_id, source, kind, ex_date, status, value from classified where status in ('set_aside', 'kept', 'contradicted')",
)
def _(t):
    return classified(t).where(F.col("status").isin("set_aside", "kept", "contradicted"))


@query(
    "unclassified_records",
    "entity_id:s source:s kind:s ex_date:d past_end:b",
    "select entity_id, source, kind, ex_date, past_end from classified where status = 'unclassified'",
)
def _(t):
    return classified(t).where("status = 'unclassified'")


@query(
    "past_series_end",
    "entity_id:s source:s kind:s ex_date:d status:s",
    "select entity_id, source, kind, ex_date, status from classified where past_end",
)
def _(t):
    return classified(t).where("past_end")


@query(
    "source_duplicates",
    "source:s entity_id:s kind:s ex_date:d n:i",
    """select concat('src', l_suppkey % 3) as source, p_brand as entity_id, 'CASH_DIVIDEND' as kind, cast(l_shipdate as date) as ex_date,
         count(*) as n from lineitem join part on p_partkey = l_partkey group by all having count(*) > 1""",
)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity_id"))
    rows = t.lineitem.join(p, "l_partkey").select(
        F.concat(F.lit("src"), F.col("l_suppkey") % 3).alias("source"),
        "entity_id",
        F.lit("CASH_DIVIDEND").alias("kind"),
        F.col("l_shipdate").cast("date").alias("ex_date"),
    )
    return rec.source_duplicates(rows)


@query(
    "reconcile_scorecard",
    "entity_id:s src0:i src1:i src2:i verified:i single_source:i",
    """with r as (select entity_id, count(*) filter (source = 'src0') as src0, count(*) filter (source = 'src1') as src1,
         count(*) filter (source = 'src2') as src2 from source_actions group by 1),
       v as (select entity_id, count(*) filter (strpos(agreeing, ',') > 0) as verified,
         count(*) filter (strpos(agreeing, ',') = 0) as single_source from reconciled group by 1)
       select coalesce(entity_id, '*') as entity_id, sum(src0) as src0, sum(src1) as src1, sum(src2) as src2,
         sum(verified) as verified, sum(single_source) as single_source from r join v using (entity_id) group by rollup (entity_id)""",
)
def _(t):
    return rec.scorecard(source_actions(t), reconciled(t), SOURCES)


@query(
    "window_scope",
    "entity_id:s kind:s ex_date:d source:s value:f6",
    """select entity_id, kind, ex_date, source, value from source_actions where exists (select 1 from (values
         (date '1995-06-01', date '1998-05-31'), (date '1999-01-01', date '2001-06-30')) w(a, z) where ex_date between a and z)""",
)
def _(t):
    return rec.window_scope(source_actions(t), WINDOWS)
