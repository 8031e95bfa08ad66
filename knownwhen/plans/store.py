"""Point-in-time store queries."""

from pyspark.sql import functions as F

from knownwhen.operators import pit
from knownwhen.plans.catalog import query
from knownwhen.plans.views import DELAYS, FALLBACK_DELAY, SQL_VIEWS


def delay():
    return pit.delay_minutes(F.col("source_id"), DELAYS, fallback=FALLBACK_DELAY)


SQL_VIEWS["visible_obs"] = """
select o.*, d.decision_at from obs o join decisions d
  on o.available_at + to_minutes(delay_min) <= d.decision_at
 and (o.vintage_at is null or o.vintage_at + to_minutes(delay_min) <= d.decision_at)"""
SQL_VIEWS["collapsed_obs"] = """
select * from (select *, row_number() over (
    partition by decision_at, source_id, entity_id, effective_at,
      case when vintage_at is null then source_locator end, vintage_at is null
    order by vintage_at desc, id desc) as rn from visible_obs) where rn = 1"""
SQL_VIEWS["stored_obs"] = """
select *, event_id as id, 'p1' as parser_version, cast(cast(value as decimal(18, 2)) as varchar) as val,
  concat('sha256:', sha256(concat('raw-', event_id % 7))) as raw_content_hash,
  concat('sha256:', sha256(concat('{"f":[', case when event_id % 53 = 0 then '"ARTIFACT_MISSING"'
    when event_id % 17 = 0 then '"STALE_BAR"' else '' end, '],"h":"sha256:', sha256(concat('raw-', event_id % 7)),
    '","v":"', cast(cast(value as decimal(18, 2)) as varchar), '"}'))) as value_hash,
  concat_ws('|', event_type, concat('loc-', event_id % 3), user_id, date_trunc('week', ts),
    case when event_type in ('view', 'click') then cast(ts as varchar) else '' end) as ident
from events"""


def stored(t):
    """Observations with the columns an append needs."""
    o = t.obs.withColumn("value", F.col("value").cast("decimal(18,2)").cast("string"))
    o = o.withColumn("raw_content_hash", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("raw-"), F.col("id") % 7), 256)))
    o = o.withColumn("parser_version", F.lit("p1"))
    return o.withColumn("value_hash", pit.value_hash(F.col("value"), F.col("raw_content_hash"), F.col("quality_flags")))


@query(
    "asof_read",
    "decision_at:t source_id:s n:i value_sum:f4 last_id:i",
    "select decision_at, source_id, count(*) as n, sum(value) as value_sum, max(id) as last_id from visible_obs group by all",
)
def _(t):
    totals = {"n": ("sum", F.lit(1)), "value_sum": ("sum", F.col("value")), "last_id": ("max", F.col("id"))}
    return pit.asof_totals(t.obs, t.decisions, delay(), ["source_id"], totals)


@query(
    "asof_latest_vintage",
    "decision_at:t source_id:s entity_id:s effective_at:t id:i value:f",
    "select decision_at, source_id, entity_id, effective_at, id, value from collapsed_obs where flag <> 'ARTIFACT_MISSING'",
)
def _(t):
    return pit.asof_latest(t.obs, t.decisions, delay())


@query(
    "asof_single_decision",
    "source_id:s entity_id:s effective_at:t id:i value:f",
    """select source_id, entity_id, effective_at, id, value from collapsed_obs
       where decision_at = timestamp '2024-01-20 18:00:00' and flag <> 'ARTIFACT_MISSING'""",
)
def _(t):
    return pit.asof_at(t.obs, F.lit("2024-01-20 18:00:00").cast("timestamp_ntz"), delay())


@query(
    "processing_delay",
    "source_id:s delay_min:i n:i",
    """select source_id, coalesce((select arg_max(m, length(p)) from (values ('view', 15), ('click', 15), ('purchase', 60),
         ('err', 0), ('sign', 1440), ('si', 5)) d(p, m) where starts_with(source_id, p)), 60) as delay_min, n
       from (select source_id, count(*) as n from obs group by 1)""",
)
def _(t):
    return pit.source_counts(t.obs).withColumn("delay_min", delay())


@query(
    "optimistic_delay_label",
    "source_id:s delay_label:s n:i",
    """select source_id, case when delay_min > 0 then 'OPTIMISTIC_DELAY' end as delay_label, count(*) as n
       from obs group by all""",
)
def _(t):
    df = pit.optimistic_delay(t.obs, F.lit(0), delay())
    return df.groupBy("source_id", "delay_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "decision_exclusion",
    "source_id:s entity_id:s n:i value_sum:f4",
    """select source_id, entity_id, count(*) as n, sum(value) as value_sum from obs
       where flag not in ('STALE', 'SCHEMA_DRIFT', 'TEMPORAL_INVERSION', 'ARTIFACT_MISSING', 'UNKNOWN_ENTITY') group by all""",
)
def _(t):
    return pit.exclude_barred(t.obs).groupBy("source_id", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")
    )


@query(
    "promotion_blockers",
    "entity_id:s blockers:s n:i",
    "select entity_id, flag as blockers, count(*) as n from obs where flag = 'ARTIFACT_MISSING' group by all",
)
def _(t):
    found = t.obs.withColumn("blockers", F.array_join(pit.promotion_blockers(F.col("quality_flags")), ","))
    return found.where("blockers <> ''").groupBy("entity_id", "blockers").agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_dedup_conflict",
    "id:i outcome:s flags:s",
    """with kept as (select * from stored_obs where ts < timestamp '2024-01-15'),
       ranked as (select b.*, min(id) over (partition by ident, value_hash) as first_id,
           min(id) over (partition by ident) as origin,
           exists (select 1 from kept k where k.ident = b.ident and k.value_hash = b.value_hash) as old,
           exists (select 1 from kept k where k.ident = b.ident) as known from stored_obs b),
       res as (select *, case when old or id > first_id then 'deduplicated' when known or first_id > origin then 'conflict'
           else 'inserted' end as outcome,
           case when id % 53 = 0 then 'ARTIFACT_MISSING' when id % 17 = 0 then 'STALE_BAR' else '' end as flag from ranked)
       select id, outcome, case when outcome <> 'conflict' then flag when flag = '' then 'CORRECTED'
         when flag < 'CORRECTED' then concat(flag, ',CORRECTED') else concat('CORRECTED,', flag) end as flags from res""",
)
def _(t):
    rows = stored(t)
    kept = rows.where(F.col("available_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return pit.append_outcome(rows, kept).withColumn("flags", F.array_join("quality_flags", ","))


@query(
    "temporal_inversion_check",
    "id:i rejected:s",
    """select event_id as id, concat_ws(',', case when epoch(ts) % 7 < 1 then 'TEMPORAL_INVERSION' end,
         case when event_id % 101 = 0 then 'BAD_HASH' end, case when event_id % 103 = 0 then 'EMPTY_ID' end) as rejected
       from events where epoch(ts) % 7 < 1 or event_id % 101 = 0 or event_id % 103 = 0""",
)
def _(t):
    n = F.col("id")
    late = (F.unix_micros(F.col("available_at").cast("timestamp")) % 7000000) < 1000000
    rows = (
        stored(t)
        .withColumn("observed_at", F.when(late, F.col("available_at") + F.expr("interval 1 second")).otherwise(F.col("available_at")))
        .withColumn("raw_content_hash", F.when(n % 101 == 0, F.lit("md5:0")).otherwise(F.col("raw_content_hash")))
        .withColumn("source_locator", F.when(n % 103 == 0, F.lit("")).otherwise(F.col("source_locator")))
    )
    out = pit.rejections(rows).where(F.size("rejected") > 0)
    return out.withColumn("rejected", F.array_join("rejected", ","))


@query(
    "quarantine_artifacts",
    "id:i available_at:t flags:s",
    """select event_id as id, greatest(ts, timestamp '2024-01-16') as available_at,
         case when event_id % 17 = 0 then 'ARTIFACT_MISSING,STALE_BAR' else 'ARTIFACT_MISSING' end as flags
       from events where event_id % 53 <> 0 and event_id % 7 in (1, 4)""",
)
def _(t):
    rows = stored(t)
    bad = rows.select("raw_content_hash").distinct().where(
        F.col("raw_content_hash").isin(*[F.concat(F.lit("sha256:"), F.sha2(F.lit(f"raw-{i}"), 256)) for i in (1, 4)])
    )
    failed = bad.withColumn("detected_at", F.lit("2024-01-16").cast("timestamp_ntz"))
    return pit.quarantine(rows, failed).withColumn("flags", F.array_join("quality_flags", ","))


@query(
    "create_snapshot",
    "dataset:s max_observation_id:i snapshot_id:s",
    """select 'obs' as dataset, max(id) as max_observation_id,
         concat('snap_obs_', substr(sha256(cast(max(id) as varchar)), 1, 16)) as snapshot_id from obs""",
)
def _(t):
    return pit.create_snapshot(t.obs, "obs")


@query(
    "snapshot_read",
    "source_id:s n:i max_id:i",
    """select source_id, count(*) as n, max(id) as max_id from obs
       where id <= (select max(id) from obs where available_at < timestamp '2024-01-15') group by 1""",
)
def _(t):
    then = t.obs.where(F.col("available_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    snaps = pit.create_snapshot(then, "obs").withColumn("snapshot_id", F.lit("mid"))
    out = pit.snapshot_read(t.obs, snaps, "mid")
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"))


@query(
    "latest_available",
    "source_id:s entity_id:s latest_available_at:t",
    "select source_id, entity_id, max(available_at) as latest_available_at from obs group by all",
)
def _(t):
    return pit.latest_available(t.obs, ["source_id", "entity_id"])


@query("source_counts", "source_id:s n:i", "select source_id, count(*) as n from obs group by 1")
def _(t):
    return pit.source_counts(t.obs)


@query(
    "pit_revision_history",
    "id:i revision:i previous_id:i previous_value:f",
    """select id, row_number() over w as revision, lag(id) over w as previous_id, lag(value) over w as previous_value
       from obs where vintage_at is not null
       window w as (partition by source_id, entity_id, effective_at order by vintage_at, id)""",
)
def _(t):
    return pit.revision_history(t.obs)
