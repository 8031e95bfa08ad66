"""Leakage and coverage audits over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownwhen.functions.columns import first_true, minutes_after, reasons
from knownwhen.operators.pit import PROMOTION_BARRED
from knownwhen.operators.scan import running


def leakage_audit(reads: DataFrame, default_delay: Column) -> DataFrame:
    """Violations of every row a decision read.

    ``reads`` carries read_seq, source_id, decision_at, decision_session, available_at,
    effective_at and the declared delay_min. Read order is checked against the running
    maximum per source, cut into blocks of the read sequence.
    """
    x = running(
        reads, ["source_id"], ["read_seq"], F.floor(F.col("read_seq") / 1048576), {"_latest": ("max", F.col("decision_at"))}, exclusive=True
    )
    usable = minutes_after(F.col("available_at"), F.col("delay_min"))
    margin = F.unix_micros(F.col("decision_at").cast("timestamp")) - F.unix_micros(usable.cast("timestamp"))
    x = x.withColumn("margin_s", margin / 1000000.0)
    return x.withColumn(
        "violations",
        reasons(
            (F.col("decision_at") < F.col("_latest"), "NON_MONOTONIC_DECISION_ORDER"),
            ((F.col("delay_min") == 0) & (default_delay > 0), "ZERO_DECLARED_DELAY"),
            (F.col("margin_s") < 0, "FUTURE_AVAILABILITY"),
            (F.col("effective_at").cast("date") > F.col("decision_session"), "FUTURE_EFFECTIVE_SESSION"),
        ),
    ).drop("_latest")


def leakage_report(audited: DataFrame) -> DataFrame:
    kinds = ("NON_MONOTONIC_DECISION_ORDER", "ZERO_DECLARED_DELAY", "FUTURE_AVAILABILITY", "FUTURE_EFFECTIVE_SESSION")
    return audited.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("margin_s").alias("min_margin_s"),
        *[F.count_if(F.array_contains("violations", F.lit(k))).alias(k.lower()) for k in kinds],
        F.count_if(F.size("violations") > 0).alias("violating_rows"),
    )


def coverage_report(entities: DataFrame, bars: DataFrame, actions: DataFrame, sessions: DataFrame, minimum: float = 0.98, blocking: Sequence[str] = PROMOTION_BARRED) -> DataFrame:
    """Expected and covered sessions, gaps, stale bars, codes and actions of every requested entity.

    ``actions`` carries entity_id, kind and quality_flags. An entity without a bar is listed as
    UNCOVERED. Codes are counted over bars, kinds over actions, as name:count in name order;
    codes that bar promotion are listed whether a bar or an action carries them. Partial
    aggregations only; gaps follow from counts and the session index, without a calendar x
    entity grid.
    """
    n = sessions.agg(F.count(F.lit(1))).scalar()
    b = bars.join(F.broadcast(sessions.select("session", "idx")), "session")
    lo, hi = F.min("idx"), F.max("idx")
    cov = b.groupBy("entity_id").agg(
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("covered"),
        (hi - lo + 1 - F.count(F.lit(1))).alias("interior_gaps"),
        (lo - 1).alias("leading_absent"),
        hi.alias("_hi"),
        F.count_if(~F.col("tradable")).alias("stale_bars"),
    )

    def counted(df: DataFrame, name: str, out: str) -> DataFrame:
        """name:count of each entity; the names are a fixed vocabulary, so the list is short."""
        n = df.groupBy("entity_id", name).agg(F.count(F.lit(1)).alias("_n"))
        return n.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", name, F.col("_n").cast("string")))).alias(out))

    of_bars = b.select("entity_id", F.explode("quality_flags").alias("code"))
    of_actions = actions.select("entity_id", F.explode("quality_flags").alias("code"))
    bars_out = of_bars.unionByName(of_actions).where(F.col("code").isin(*blocking)).groupBy("entity_id").agg(F.array_sort(F.collect_set("code")).alias("blocking"))
    act = actions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_actions"))
    out = entities.select("entity_id").distinct().join(cov, "entity_id", "left")
    for side in (counted(of_bars, "code", "codes"), counted(actions, "kind", "kinds"), bars_out, act):
        out = out.join(side, "entity_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("codes", "kinds", "blocking")})
    zero = ("covered", "interior_gaps", "stale_bars")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("expected", n)
    out = out.withColumns({"leading_absent": F.coalesce("leading_absent", "expected"), "_hi": F.coalesce("_hi", "expected")})
    out = out.withColumn("coverage", F.col("covered") / F.col("expected"))
    status = first_true((F.col("covered") == 0, "UNCOVERED"), (F.col("coverage") < minimum, "BELOW_MINIMUM"), default=F.lit("OK"))
    return (
        out.withColumn("trailing_absent", F.col("expected") - F.col("_hi"))
        .withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))
        .withColumn("status", status)
        .drop("_hi")
    )
