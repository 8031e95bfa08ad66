"""The same rules as the batch operators over tables that keep growing.

Each job takes a streaming DataFrame and returns one, or starts a micro-batch append.
State is keyed and bounded by watermarks or by one small record per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import IntegerType, StructField, StructType

from knownwhen import session
from knownwhen.functions.columns import key_text
from knownwhen.operators import pit


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder, as a stream; the schema comes from the files already there."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a glob, so that a single file is accepted too
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a parquet table, and read that back."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


STORE_PARTS = 64


def _part(parts: int):
    return F.pmod(F.xxhash64(key_text(*pit.IDENTITY)), F.lit(parts)).cast("int").alias("part")


def append_batch(batch: DataFrame, table: str, rejected: str, batch_id: int = 0, parts: int = STORE_PARTS) -> None:
    """One micro-batch of the append rules: refuse, deduplicate, flag conflicts, append.

    The store is partitioned by a hash of the identity, ``part``; only the parts that the batch's identities fall
    into are listed and read, and of them the identities of the batch, by semi join. ``parts`` stays the same for the
    life of a store. A retried batch finds its own rows and appends nothing; its refused rows replace those of the
    first try. The batch is read several times, so it is kept for the length of the call.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        checked = pit.rejections(batch.withColumn("value_hash", pit.value_hash(F.col("value"), F.col("raw_content_hash"), F.col("quality_flags"))))
        good, bad = checked.where(F.size("rejected") == 0).drop("rejected"), checked.where(F.size("rejected") > 0)
        touched = [r["part"] for r in good.select(_part(parts)).distinct().collect()]  # at most ``parts`` numbers
        stored = open_store(spark, table, good.schema).where(F.col("part").isin(touched)).drop("part")
        out = pit.append_outcome(good, stored).where(F.col("outcome") != "deduplicated").drop("outcome")
        out.select(*good.columns, _part(parts)).hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(table)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
    finally:
        batch.unpersist()


def open_store(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The store that append_batch writes, without opening files for their schema.

    Before the first batch it is laid out as an empty part, -1, so that a store without rows can be read too.
    """
    whole = StructType([*schema, StructField("part", IntegerType())])
    try:
        return spark.read.schema(whole).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/part=-1")
        return spark.read.schema(whole).parquet(table)


def stream_append(stream: DataFrame, table: str, rejected: str, checkpoint: str):
    """Start the append job; a stream of landed observations into the store."""
    q = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, table, rejected, n))
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_bars(ticks: DataFrame, delay: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Daily bars from ticks (ts, price, size) as one stream; ticks later than the processing delay are dropped, land_bars() keeps them.

    Open and close are the first and last tick of the day. State is one row per key and
    open day.
    """
    day = F.window("ts", "1 day")
    g = ticks.withWatermark("ts", delay).groupBy(*keys, day).agg(
        F.min_by("price", F.struct("ts", "tick_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "tick_id")).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return g.select(*keys, F.col("window.start").cast("date").alias("session"), "open", "high", "low", "close", "volume", "n")


def append_bars(batch: DataFrame, base: str, delay: str, keys: tuple[str, ...] = ("entity_id",), batch_id: int = 0) -> None:
    """One micro-batch of the bars: a part of each day's bar, the batch's newest tick, and the ticks of days already closed.

    All three are written below ``base`` in a folder of the batch, which a retried batch overwrites. A day
    is closed once the newest tick of the batches before is more than the delay past its end.
    """
    batch = batch.persist()
    day = F.window("ts", "1 day")
    first = F.struct("ts", "tick_id", "price")
    parts = batch.where("ts is not null").groupBy(*keys, day).agg(
        F.min(first).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(first).alias("last"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    parts.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "first", "high", "low", "last", "volume", "n").write.mode("overwrite").parquet(f"{base}/parts/batch={batch_id}")
    closed = _newest(batch.sparkSession, base, delay, batch_id)
    late = batch.withColumn("_day", day).where(F.col("_day.end").cast("timestamp") <= F.timestamp_micros(F.lit(closed).cast("long"))).drop("_day")
    late.write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
    batch.agg(F.max("ts").cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{base}/clock/batch={batch_id}")
    batch.unpersist()


def _newest(spark: SparkSession, base: str, delay: str, before: int | None = None) -> int | None:
    """The watermark, in microseconds: the delay before the newest tick of all batches, or of those before one."""
    try:
        clock = spark.read.schema("newest timestamp, batch long").parquet(f"{base}/clock")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    clock = clock if before is None else clock.where(F.col("batch") < before)
    return clock.agg(F.unix_micros(F.max("newest") - F.expr(f"interval {delay}"))).first()[0]


def land_bars(ticks: DataFrame, base: str, checkpoint: str, delay: str, keys: tuple[str, ...] = ("entity_id",)):
    """Start the bars job over what is there now; bars() reads its closed days, ``base``/late holds the late ticks."""
    q = ticks.writeStream.foreachBatch(lambda df, n: append_bars(df, base, delay, keys, n))
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars(spark: SparkSession, base: str, delay: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Bars of the closed days, from all ticks that have landed: a late tick restates its bar."""
    parts = spark.read.parquet(f"{base}/parts")
    parts = parts.where(F.col("end").cast("timestamp") <= F.timestamp_micros(F.lit(_newest(spark, base, delay)).cast("long")))
    g = parts.groupBy(*keys, "start").agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"), F.sum("n").alias("n"),
    )
    return g.select(*keys, F.col("start").cast("date").alias("session"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "n")


def stream_stale_alert(arrivals: DataFrame, limit: str, lateness: str) -> DataFrame:
    """Silences longer than a limit: a source's activity is a session window that ends with the gap.

    A closed session means the source fell silent at ``last_seen`` for at least the limit.
    """
    w = F.session_window("ts", limit)
    g = arrivals.withWatermark("ts", lateness).groupBy("source_id", w).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return g.select("source_id", F.col("session_window.start").alias("active_from"), "last_seen", "n")


def _halt_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sticky halt state of one arm: escalate to the faults, one step down per owner re-arm."""
    rank = state.get[0] if state.exists else 0
    out = []
    for r in pd.concat(list(batches)).sort_values("session").itertuples(index=False):
        nxt = max(rank, r.floor_rank) if pd.isna(r.rearm_to) else max(r.floor_rank, int(r.rearm_to), rank - 1)
        out.append((key[0], r.session, rank, int(nxt)))
        rank = int(nxt)
    state.update((rank,))
    yield pd.DataFrame(out, columns=["arm", "session", "from_rank", "rank"])


def stream_halt(faults: DataFrame) -> DataFrame:
    """Halt state as decisions arrive; (arm, session, floor_rank, rearm_to), one small record of state per arm."""
    rows = faults.select(
        F.col("arm").cast("bigint").alias("arm"), "session", F.col("floor_rank").cast("int").alias("floor_rank"), F.col("rearm_to").cast("double").alias("rearm_to")
    )
    schema = "arm bigint, session date, from_rank int, rank int"
    return rows.groupBy("arm").applyInPandasWithState(_halt_step, schema, "rank int", "append", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for stream output and checkpoints below the one that all executors see."""
    return f"{session.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
