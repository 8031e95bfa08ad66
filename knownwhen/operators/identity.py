"""Symbol ranges, symbol resolution and universe membership, all as known at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import minutes_after
from knownwhen.operators.pit import win_intervals, with_visibility
from knownwhen.operators.scan import interval_join, running
from knownwhen.session import materialise

RANGE_FLOOR = "1800-01-01"


def _open_at(date: Column, known: Column) -> Column:
    """A close that is not yet known leaves its range open."""
    still = F.col("effective_to").isNull() | (F.col("effective_to") >= date) | (F.col("close_known_from") > known)
    return (F.col("effective_from") <= date) & still & (F.col("known_from") <= known)


def resolve_symbol(requests: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Entity a symbol denoted on ``on_date`` as known at ``known_at``; null if none or ambiguous.

    Ambiguity is min = max over the matches, so no list of candidates is built. Equal questions are asked once, and
    ranges that differ in their entity alone are one with its least and greatest entity, so that both sides grow with
    the dates and not with the rows of a symbol. A range matches in either of two ways, each an interval join: the
    date lies within it, or the request falls between its opening and its close becoming known.
    """
    span = ["symbol", "effective_from", "effective_to", "known_from", "close_known_from"]
    r = materialise(ranges.groupBy(*span).agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi")))
    ask = ["symbol", "on_date", "known_at"]
    q = materialise(requests.where("symbol is not null and on_date is not null and known_at is not null").select(*ask).distinct())
    dated = interval_join(r, q, ["symbol"], "effective_from", "effective_to", "on_date", unit="month", closed=True)
    dated = dated.where(F.col("known_from") <= F.col("known_at"))
    unclosed = r.where("effective_to is not null and close_known_from is not null")
    unclosed = interval_join(unclosed, q, ["symbol"], "known_from", "close_known_from", "known_at", unit="month")
    unclosed = unclosed.where((F.col("effective_from") <= F.col("on_date")) & (F.col("effective_to") < F.col("on_date")))
    hits = dated.select(*ask, "_lo", "_hi").unionByName(unclosed.select(*ask, "_lo", "_hi"))
    hits = hits.groupBy(*ask).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    found = requests.select(key, *ask).join(hits, ask, "left").groupBy(key).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return found.select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("entity_id"))


def symbols_for_entity(ranges: DataFrame, known_at: Column) -> DataFrame:
    known = ranges.where(F.col("known_from") <= known_at)
    return known.groupBy("entity_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def symbol_on(requests: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Symbol an entity traded under on a date: the newest range open then."""
    r = ranges.withColumnRenamed("entity_id", "_e")
    cond = (requests["entity_id"] == F.col("_e")) & _open_at(F.col("on_date"), F.col("known_at"))
    hit = requests.join(r, cond, "left")
    return hit.groupBy(key).agg(F.max_by("symbol", F.struct("effective_from", "id")).alias("symbol"))


def close_open_ranges(regs: DataFrame) -> DataFrame:
    """A later registration of a symbol by another entity closes the open range the day before.

    Works on distinct start dates per symbol; the close is known when the next one is.
    """
    starts = regs.groupBy("symbol", "effective_from").agg(F.min("known_from").alias("_known"))
    nxt = F.struct(F.col("effective_from").alias("d"), F.col("_known").alias("k"))
    starts = running(
        starts, ["symbol"], ["effective_from"], F.year("effective_from"), {"_next": ("min", nxt)}, exclusive=True, reverse=True
    )
    out = regs.join(starts.select("symbol", "effective_from", "_next"), ["symbol", "effective_from"])
    return out.withColumn("effective_to", F.date_sub("_next.d", 1)).withColumn("close_known_from", F.col("_next.k")).drop("_next")


def range_conflicts(ranges: DataFrame) -> DataFrame:
    """Overlapping ranges of one symbol by different entities that registration cannot close.

    A later start inside a closed range conflicts; an open earlier range is closed
    instead, unless both start on the same day. Only conflicting pairs are emitted.

    The pairs may be far more than the ranges. Two entities with one range each meet once, so their pairs leave the join
    as they are; only those of an entity with several ranges of the symbol are grouped.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy("symbol", "entity_id")) > 1
    r = materialise(ranges.select("symbol", "entity_id", "effective_from", "effective_to", several.alias("_several")))
    once, more = r.where("not _several"), r.where("_several")
    grouped = _conflicting_pairs(more, r).unionByName(_conflicting_pairs(once, more))
    grouped = grouped.groupBy("symbol", "effective_from", "entity_a", "entity_b").agg(F.min("held_from").alias("held_from"), F.max("held_to").alias("held_to"))
    return _conflicting_pairs(once, once).unionByName(grouped)


def _conflicting_pairs(holders: DataFrame, starts: DataFrame) -> DataFrame:
    """Each range of ``starts`` with each of ``holders`` that holds its first day, one row for two ranges."""
    held = [F.col("entity_id").alias("holder"), F.col("effective_from").alias("held_from"), F.col("effective_to").alias("held_to")]
    closed = holders.where(F.col("effective_to").isNotNull()).select("symbol", *held)
    b = starts.select("symbol", "entity_id", "effective_from", "effective_to")
    # Of two that start on one day the smaller holds, unless it ends before it starts and so holds nothing.
    first = (F.col("holder") < F.col("entity_id")) | ((F.col("effective_to") < F.col("effective_from")) & (F.col("holder") > F.col("entity_id")))
    inside = interval_join(closed, b, ["symbol"], "held_from", "held_to", "effective_from", unit="month", closed=True)
    inside = inside.where((F.col("holder") != F.col("entity_id")) & ((F.col("held_from") < F.col("effective_from")) | first))
    o = holders.where(F.col("effective_to").isNull()).select(F.col("symbol").alias("_symbol"), *held)
    same = b.join(o, (F.col("symbol") == F.col("_symbol")) & (F.col("effective_from") == F.col("held_from"))).where(first)
    a, z = F.least("entity_id", "holder").alias("entity_a"), F.greatest("entity_id", "holder").alias("entity_b")
    cols = ["symbol", "effective_from", a, z, "held_from", "held_to"]
    return inside.select(*cols).unionByName(same.select(*cols))


def build_ranges(actions: DataFrame, delay: Column) -> DataFrame:
    """Identity effects of corporate actions as ranges, each knowable from its own availability.

    A symbol change opens the new symbol and ends the old one the day before, creating the
    old range from the floor date when nothing recorded it; a merger or delisting ends
    every open range; a spin-off opens the child.
    """
    a = actions.withColumn("known_from", minutes_after(F.col("available_at"), delay))
    change = a.where(F.col("kind") == "SYMBOL_CHANGE")
    floor = F.lit(RANGE_FLOOR).cast("date")
    opens = change.select("entity_id", F.col("new_symbol").alias("symbol"), F.col("effective_date").alias("effective_from"), "known_from", F.lit(False).alias("closed"))
    spun = a.where(F.col("kind") == "SPINOFF").select(
        F.col("child").alias("entity_id"), F.col("child").alias("symbol"), F.col("effective_date").alias("effective_from"), "known_from", F.lit(False).alias("closed")
    )
    # An old symbol nobody opened before the change is materialised as a closed range.
    first_open = opens.groupBy("entity_id", "symbol").agg(F.min("effective_from").alias("_opened"))
    old = change.groupBy("entity_id", F.col("old_symbol").alias("symbol")).agg(
        F.min_by(F.struct("effective_date", "known_from"), "effective_date").alias("_c")
    )
    unseen = old.join(first_open, ["entity_id", "symbol"], "left").where(
        F.col("_opened").isNull() | (F.col("_opened") >= F.col("_c.effective_date"))
    )
    made = unseen.select(
        "entity_id", "symbol", floor.alias("effective_from"), F.col("_c.known_from").alias("known_from"),
        F.date_sub("_c.effective_date", 1).alias("effective_to"), F.col("_c.known_from").alias("close_known_from"),
    )
    ends = a.where(F.col("kind").isin("MERGER", "DELISTING")).select(
        "entity_id", F.lit(None).cast("string").alias("_sym"),
        F.when(F.col("kind") == "DELISTING", F.col("effective_date")).otherwise(F.date_sub("effective_date", 1)).alias("_to"),
        F.col("known_from").alias("_k"),
    ).unionByName(
        change.select("entity_id", F.col("old_symbol").alias("_sym"), F.date_sub("effective_date", 1).alias("_to"), F.col("known_from").alias("_k"))
    )
    ranges = opens.unionByName(spun).drop("closed")
    e2 = ends.withColumnRenamed("entity_id", "_e")
    hit = ranges.join(
        e2,
        (F.col("entity_id") == F.col("_e")) & (F.col("_sym").isNull() | (F.col("_sym") == F.col("symbol"))) & (F.col("_to") >= F.col("effective_from")),
        "left",
    )
    done = hit.groupBy("entity_id", "symbol", "effective_from", "known_from").agg(F.min(F.struct("_to", "_k")).alias("_end"))
    return done.select(
        "entity_id", "symbol", "effective_from", "known_from", F.col("_end._to").alias("effective_to"), F.col("_end._k").alias("close_known_from")
    ).unionByName(made)


def members_asof(snapshots: DataFrame, decisions: DataFrame, delay: Column, unit: str = "month") -> DataFrame:
    """Members of the newest snapshot (by effective date, then id) visible at each decision."""
    s = with_visibility(snapshots.withColumn("vintage_at", F.lit(None).cast("timestamp_ntz")), delay).drop("vintage_at")
    wins = win_intervals(s, ["universe_id"], ["effective_at", "id"], F.year("effective_at"))
    out = interval_join(wins, decisions, [], "visible_at", "visible_to", "decision_at", unit=unit)
    return survivorship_label(out).withColumn("entity_id", F.explode("members")).drop("members")


def survivorship_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.when(~F.col("survivorship_free"), F.lit("SURVIVORSHIP_BIASED")))


def admitted_members(members: DataFrame, conditional: DataFrame) -> DataFrame:
    """Members minus conditional ones that were not positively admitted; undecided means out."""
    blocked = conditional.where(~F.coalesce(F.col("admitted"), F.lit(False))).select("entity_id")
    return members.join(blocked, "entity_id", "left_anti")
