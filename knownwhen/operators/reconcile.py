"""Agreement of corporate actions reported by several sources.

Records carry ``entity_id, kind, ex_date, source, value`` (decimal) and ``locator``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("entity_id", "kind", "ex_date")


def window_scope(records: DataFrame, windows: Sequence[tuple[str, str]]) -> DataFrame:
    """Records inside any configured ex-date window; the bounds are literals and get pushed down."""
    hit = F.lit(False)
    for lo, hi in windows:
        hit = hit | F.col("ex_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    return records.where(hit)


def source_duplicates(records: DataFrame) -> DataFrame:
    """Keys one source reports more than once; components must be summed before reconciling."""
    return records.groupBy("source", *KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def classify(records: DataFrame, structural: DataFrame, selectors: DataFrame) -> DataFrame:
    """Add ``status`` and ``past_end`` to each record.

    A record on the day of a structural action or past the end of its entity's series must
    be named by a selector: superseded (set aside) or kept. Unnamed ones are unclassified;
    named by both is contradicted. Everything else is in scope.
    """
    days = structural.groupBy("entity_id", "ex_date").agg(F.lit(True).alias("_day"))
    ends = structural.where(F.col("last_date").isNotNull()).groupBy("entity_id").agg(F.min("last_date").alias("_end"))
    sel = selectors.groupBy("entity_id", "source", "kind", "ex_date").agg(
        F.max(F.col("choice") == "supersedes").alias("_sup"), F.max(F.col("choice") == "keeps").alias("_keep")
    )
    out = (
        records.join(days, ["entity_id", "ex_date"], "left")
        .join(ends, "entity_id", "left")
        .join(sel, ["entity_id", "source", "kind", "ex_date"], "left")
        .withColumn("past_end", F.coalesce(F.col("ex_date") > F.col("_end"), F.lit(False)))
    )
    touched = F.col("past_end") | F.col("_day").isNotNull()
    status = (
        F.when(~touched, "in_scope")
        .when(F.col("_sup") & F.col("_keep"), "contradicted")
        .when(F.col("_sup"), "set_aside")
        .when(F.col("_keep"), "kept")
        .otherwise("unclassified")
    )
    return out.withColumn("status", status).drop("_day", "_end", "_sup", "_keep")


def in_scope(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status").isin("in_scope", "kept"))


def reconcile(records: DataFrame, preferred: Sequence[str], tolerance: Decimal) -> DataFrame:
    """One row per action: chosen source and value, agreeing sources, verified or not.

    The first preferred source that reports the action carries its value, else the
    alphabetically first. Cash amounts agree within the tolerance, splits exactly.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("source")), F.lit(0))
    rank = F.when(rank == 0, F.lit(len(preferred) + 1)).otherwise(rank)
    chosen = records.groupBy(*KEY).agg(
        F.min_by(F.struct(F.col("source").alias("chosen"), F.col("value").alias("chosen_value")), F.struct(rank, F.col("source"))).alias("_c")
    )
    both = records.join(chosen, list(KEY))
    gap = F.abs(F.col("value") - F.col("_c.chosen_value"))
    agree = F.when(F.col("kind") == "CASH_DIVIDEND", gap <= F.lit(tolerance)).otherwise(gap == 0)
    out = both.groupBy(*KEY).agg(
        F.first("_c").alias("_c"),
        F.array_sort(F.collect_set("source")).alias("present"),
        F.array_sort(F.collect_set(F.when(agree, F.col("source")))).alias("agreeing"),
        F.array_sort(F.collect_set(F.struct("source", "value"))).alias("values"),
    )
    return out.select(
        *KEY, "_c.*", "present", "agreeing", "values", (F.size("agreeing") >= 2).alias("verified")
    )


def findings(reconciled: DataFrame) -> DataFrame:
    """Actions that are not settled: unverified, or with a source that disagrees."""
    return reconciled.where(~F.col("verified") | (F.size("agreeing") < F.size("present")))


def disagreements(reconciled: DataFrame) -> DataFrame:
    return findings(reconciled).where(F.size("present") >= 2)


def one_sided(reconciled: DataFrame) -> DataFrame:
    return findings(reconciled).where(F.size("present") == 1)


def near_matches(reconciled: DataFrame, records: DataFrame, days: int = 5) -> DataFrame:
    """Same entity and kind in a source absent from a finding, within a few days of it.

    The finding is expanded over its few neighbouring dates, so the join is an equi-join.
    """
    offsets = F.array(*[F.lit(i) for i in range(-days, days + 1) if i])
    f = findings(reconciled).select(*KEY, "present", F.explode(offsets).alias("_o"))
    f = f.withColumn("near_date", F.date_add("ex_date", F.col("_o")))
    r = records.select(
        "entity_id", "kind", F.col("ex_date").alias("near_date"), F.col("source").alias("near_source"), F.col("value").alias("near_value")
    )
    hit = f.join(r, ["entity_id", "kind", "near_date"])
    return hit.where(~F.array_contains("present", F.col("near_source"))).drop("_o", "present")


def scorecard(records: DataFrame, reconciled: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per entity: records by source, verified and single-source actions, with a grand total."""
    by = records.groupBy("entity_id").agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])
    ok = reconciled.groupBy("entity_id").agg(
        F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("single_source")
    )
    per = by.join(ok, "entity_id", "full_outer").na.fill(0)
    cols = [*sources, "verified", "single_source"]
    return per.rollup("entity_id").agg(*[F.sum(x).alias(x) for x in cols]).withColumn(
        "entity_id", F.coalesce("entity_id", F.lit("*"))
    )
