"""Streaming queries: each drains a stream over the driver tables and returns the table it wrote."""

from pyspark.sql import functions as F

from knownwhen.plans.catalog import query
from knownwhen.plans.controls import _LEGAL, fault_rows, order_log
from knownwhen.plans.store import stored
from knownwhen.plans.views import SQL_VIEWS
from knownwhen.streaming import jobs, keyed


def _events(t):
    return jobs.read_table(t.spark, f"{t.dir}/events.parquet")


@query(
    "stream_append", "id:i flags:s",
    """with ranked as (select b.*, min(id) over (partition by ident, value_hash) as first_id, min(id) over (partition by ident) as origin,
           case when id % 53 = 0 then 'ARTIFACT_MISSING' when id % 17 = 0 then 'STALE_BAR' else '' end as flag from stored_obs b)
       select id, case when first_id = origin then flag when flag = '' then 'CORRECTED' when flag < 'CORRECTED' then concat(flag, ',CORRECTED') else concat('CORRECTED,', flag) end as flags
       from ranked where id = first_id""",
)
def _(t):
    class Live:
        """The stored view over a stream of the same table."""

        obs = type(t).obs.func(type("S", (), {"events": _events(t)})())

    base = jobs.shared_folder(t.spark)
    rows = stored(Live).drop("value_hash").withColumn("observed_at", F.col("available_at"))
    jobs.stream_append(rows, f"{base}/store", f"{base}/rejected", f"{base}/cp").awaitTermination()
    out = t.spark.read.parquet(f"{base}/store")
    return out.withColumn("flags", F.array_join("quality_flags", ","))


_DAY = """select event_type as entity_id, cast(ts as date) as session, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close,
  sum(user_id) as volume, count(*) as n from events group by 1, 2"""


@query(
    "stream_bars", "entity_id:s session:d open:f4 high:f4 low:f4 close:f4 volume:i n:i",
    f"""select * from ({_DAY}) where session + 1 <= (select max(ts) - interval 1 hour from events)""",
)
def _(t):
    """Days are emitted once the watermark (one hour behind the newest tick) has passed them; late ticks restate them."""
    ticks = _events(t).select(
        F.col("event_type").alias("entity_id"), F.col("event_id").alias("tick_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("user_id").alias("size")
    )
    base = jobs.shared_folder(t.spark)
    jobs.land_bars(ticks, f"{base}/bars", f"{base}/cp", "1 hour").awaitTermination()
    return jobs.bars(t.spark, f"{base}/bars", "1 hour")


@query(
    "stream_stale_alert", "source_id:s active_from:t last_seen:t n:i",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
         s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
       select * from (select cast(user_id as varchar) as source_id, min(ts) as active_from, max(ts) as last_seen, count(*) as n from s group by user_id, k)
       where last_seen + interval 12 hour <= (select max(ts) - interval 1 hour from events)""",
)
def _(t):
    a = _events(t).select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    base = jobs.shared_folder(t.spark)
    return jobs.drain(jobs.stream_stale_alert(a, "12 hours", "1 hour"), f"{base}/out", f"{base}/cp")


@query("stream_halt", "arm:i session:d from_rank:i rank:i", "select arm, session, from_rank, r as rank from halt_chain")
def _(t):
    """Fault rows land as a table first; the state machine then reads it as a stream."""
    base = jobs.shared_folder(t.spark)
    fault_rows(t).select("arm", "session", "floor_rank", "rearm_to").write.parquet(f"{base}/faults")
    stream = jobs.read_table(t.spark, f"{base}/faults")
    return jobs.drain(jobs.stream_halt(stream), f"{base}/out", f"{base}/cp")


@query(
    "stream_silence", "source_id:s kind:s told_at:t last_seen:t",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
         s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g),
         z as (select cast(user_id as varchar) as source_id, min(ts) as first_seen, max(ts) as last_seen from s group by user_id, k),
         b as (select *, lag(last_seen) over (partition by source_id order by first_seen) as before from z),
         m as (select date_trunc('milliseconds', max(ts) - interval 1 hour) as mark from events)
       select source_id, 'SILENT' as kind, last_seen + interval 12 hour as told_at, last_seen from b, m where last_seen + interval 12 hour <= mark
       union all select source_id, 'BACK', first_seen, before from b, m where before is not null and first_seen <= mark""",
)
def _(t):
    a = _events(t).select(F.col("user_id").alias("source_id"), "ts")
    base = jobs.shared_folder(t.spark)
    return jobs.drain(keyed.stream_silence(a, "12 hours", "1 hour"), f"{base}/out", f"{base}/cp")


@query(
    "stream_order_audit", "seq:i from_state:s issues:s",
    f"""with x as (select *, lag(state) over w as from_state, max(cum_qty) over (w rows between unbounded preceding and 1 preceding) as mx from order_log window w as (partition by order_id order by seq)),
         y as (select *, (from_state, state) in ({_LEGAL}) as ok from x)
       select * from (select seq, from_state, concat_ws(',', case when from_state is not null and not ok then 'ILLEGAL_TRANSITION' end,
         case when ok and from_state = 'UNKNOWN' and not starts_with(reason, 'reconciliation:') then 'RECONCILE_ONLY' end,
         case when ok and from_state = 'FILLED' and state = 'CLOSED' and side <> 'SELL' then 'EXIT_ONLY' end,
         case when state in ('PARTIALLY_FILLED', 'FILLED') and mx > 0 and cum_qty <= mx then 'STALE_FILL' end) as issues from y
         union all select seq, state, 'DUPLICATE_EVENT' from order_log where seq % 19 = 0)
       where issues <> '' and seq + 600 <= (select max(seq) from order_log)""",
)
def _(t):
    """Every nineteenth event is delivered twice, as brokers do, and labelled; events wait for the watermark, ten minutes behind."""
    log = order_log(type("S", (), {"events": _events(t)}))
    n = F.col("seq")
    twice = F.when(n % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    log = log.withColumn("event_id", F.concat(F.lit("e"), n)).withColumn("copy", F.explode(twice)).drop("copy")
    base = jobs.shared_folder(t.spark)
    audit = keyed.stream_order_audit(log.withColumn("at", F.timestamp_seconds(n + 86400)), "10 minutes")
    return jobs.drain(audit, f"{base}/out", f"{base}/cp")
