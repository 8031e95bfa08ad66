"""Hash-chain, seal, order-log and health audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownwhen.functions.columns import reasons
from knownwhen.operators.scan import running
from knownwhen.session import materialise

# Order states a state may move to.
TRANSITIONS = {
    "CREATED": ("VALIDATED", "REJECTED"),
    "VALIDATED": ("AWAITING_APPROVAL", "APPROVED", "REJECTED"),
    "AWAITING_APPROVAL": ("APPROVED", "REJECTED", "CANCELED"),
    "APPROVED": ("SUBMITTING", "CANCELED"),
    "SUBMITTING": ("ACKNOWLEDGED", "REJECTED", "UNKNOWN"),
    "UNKNOWN": ("ACKNOWLEDGED", "REJECTED", "PARTIALLY_FILLED", "FILLED", "CANCELED"),
    "ACKNOWLEDGED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "UNKNOWN"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "PROTECTION_PENDING", "UNKNOWN"),
    "FILLED": ("PROTECTION_PENDING", "CLOSED"),
    "PROTECTION_PENDING": ("PROTECTED", "PROTECTION_FAILED", "UNKNOWN"),
    "PROTECTION_FAILED": ("PROTECTION_PENDING", "EXIT_PENDING"),
    "PROTECTED": ("EXIT_PENDING", "PROTECTION_PENDING"),
    "CANCEL_PENDING": ("CANCELED", "FILLED", "PARTIALLY_FILLED", "UNKNOWN"),
    "EXIT_PENDING": ("CLOSED", "UNKNOWN", "PARTIALLY_FILLED"),
    "CLOSED": (),
    "CANCELED": (),
    "REJECTED": (),
}


def hash_chain_verify(events: DataFrame, body: Column) -> DataFrame:
    """Breaks of a hash chain: sequence gap, previous-hash mismatch, hash mismatch.

    Each row checks its own link against the row with the sequence number before it: an
    equi-join, so the chain is verified in parallel and no ordered scan of the whole ledger
    is needed.
    """
    x = events.withColumn("_want", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.coalesce("prev_hash", F.lit("")), body), 256))
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"), F.lit(True).alias("_has"))
    first = events.agg(F.min("seq")).scalar()
    x = x.join(before, "seq", "left").withColumn("_first", F.col("seq") == first)
    why = reasons(
        (F.col("_has").isNull() & ~F.col("_first"), "SEQUENCE_GAP"),
        (F.col("_has") & ~F.col("prev_hash").eqNullSafe(F.col("_before")), "PREV_HASH_MISMATCH"),
        (F.col("hash") != F.col("_want"), "HASH_MISMATCH"),
    )
    return x.withColumn("breaks", why).drop("_want", "_before", "_has", "_first")


def chain_report(verified: DataFrame, last_sealed: Column) -> DataFrame:
    return verified.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.size("breaks") > 0).alias("broken"),
        F.min(F.when(F.size("breaks") > 0, F.col("seq"))).alias("first_break"),
        F.count_if(F.col("seq") > last_sealed).alias("tail"),
    )


def _seal_days(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Root of each date out of rows that arrive sorted by date and sequence."""
    day, digest, first, last, n = None, None, None, None, 0
    for pdf in batches:
        done = []
        for d, part in pdf.groupby("day", sort=False):
            if d != day:
                if day is not None:
                    done.append((day, digest.hexdigest(), first, last, n))
                day, digest, first, n = d, hashlib.sha256(), int(part["seq"].iloc[0]), 0
            digest.update("".join(part["hash"]).encode())
            last, n = int(part["seq"].iloc[-1]), n + len(part)
        if done:
            yield pd.DataFrame(done, columns=["day", "root", "first_seq", "last_seq", "events"])
    if day is not None:
        yield pd.DataFrame([(day, digest.hexdigest(), first, last, n)], columns=["day", "root", "first_seq", "last_seq", "events"])


def daily_seals(events: DataFrame) -> DataFrame:
    """Root over a UTC date's hashes in sequence, with its first and last sequence.

    The root is one hash over the whole date, which is sequential by definition. Only the
    hashes are shuffled, Spark sorts them with spilling, and each date is streamed through
    the digest batch by batch: no date is ever held in memory. A date is bound to one core;
    ``merkle_seals`` spreads it.
    """
    rows = events.select(F.col("at").cast("date").alias("day"), "seq", "hash")
    rows = rows.repartition("day").sortWithinPartitions("day", "seq")
    return rows.mapInPandas(_seal_days, "day date, root string, first_seq bigint, last_seq bigint, events bigint")


#: Children of a node of the seal tree (a power of two), and its levels: 64**6 sequence numbers before the topmost node of a date is wider.
FANOUT, DEPTH = 64, 6


def _leaf(seq: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("0"), seq.cast("string"), F.coalesce(digest, F.lit(""))), 256)


def _node(children: Column) -> Column:
    """Hash over a node's children in order; an only child stands for itself, so the root does not depend on the depth."""
    text = F.array_join(F.transform(children, lambda x: F.concat(x["block"].cast("string"), F.lit(":"), x["node"])), ",")
    return F.when(F.size(children) == 1, children[0]["node"]).otherwise(F.sha2(F.concat(F.lit("1"), text), 256))


def _level(below: DataFrame, level: int) -> DataFrame:
    """Nodes of one level. A group holds ``FANOUT`` children at most, however many events a date has."""
    block = F.lit(0).cast("bigint") if level == DEPTH else F.shiftright("block", FANOUT.bit_length() - 1)
    kids = below.select("day", block.alias("_up"), F.struct("block", "node").alias("_kid"), "first_seq", "last_seq", "events")
    out = kids.groupBy("day", F.col("_up").alias("block")).agg(
        F.array_sort(F.collect_list("_kid")).alias("children"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("events").alias("events"),
    )
    return out.withColumn("node", _node(F.col("children")))


def _leaves(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("at").cast("date").alias("day"), F.col("seq").alias("block"), _leaf(F.col("seq"), F.col("hash")).alias("node"),
        F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.lit(1).cast("bigint").alias("events"),
    )


def merkle_seals(events: DataFrame) -> DataFrame:
    """Root of a hash tree over each UTC date, with its first and last sequence number.

    Unlike ``daily_seals``, whose root is one hash over the date and so bound to one core, the blocks of a date are hashed
    by many tasks; each level is a grouping of a 64th of the rows below. ``seq`` is unique. Neither the order of the rows
    nor their partitions matter. No events, no seals; a missing hash is an empty one.
    """
    below = _leaves(events)
    for level in range(1, DEPTH + 1):
        below = _level(below, level)
    return below.select("day", F.col("node").alias("root"), "first_seq", "last_seq", "events")


def merkle_nodes(events: DataFrame) -> DataFrame:
    """All nodes of the trees: day, level (1 above the events), block, node, children, first_seq, last_seq, events.

    The lowest level holds every event's leaf and is written once; those above are built from its nodes alone.
    """
    low = materialise(_level(_leaves(events), 1))
    levels, below = [low.withColumn("level", F.lit(1))], low
    for level in range(2, DEPTH + 1):
        below = _level(below, level)
        levels.append(below.withColumn("level", F.lit(level)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def inclusion_proofs(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (day, seq) the children on its way to the root, lowest level first; no row for an event the tree lacks.

    A step names the child (``child``) that the level below must hash to. A proof holds ``FANOUT`` hashes a level, not the date.
    """
    at = [F.shiftright("seq", k * (FANOUT.bit_length() - 1)) for k in range(DEPTH)] + [F.lit(0).cast("bigint")]
    steps = F.array(*[F.struct(F.lit(k).alias("level"), at[k].alias("block"), at[k - 1].alias("child")) for k in range(1, DEPTH + 1)])
    path = asked.select("day", "seq").distinct().select("day", "seq", F.inline(steps))
    hit = path.join(nodes.select("day", "level", "block", "children"), ["day", "level", "block"])
    out = hit.groupBy("day", "seq").agg(F.array_sort(F.collect_list(F.struct("level", "child", "children"))).alias("path"))
    first = F.col("path")[0]["children"]
    return out.where((F.size("path") == DEPTH) & F.exists(first, lambda x: x["block"] == F.col("seq")))


def verify_proofs(proofs: DataFrame, events: DataFrame, roots: DataFrame) -> DataFrame:
    """Whether each proof leads from the event's own hash to the root of its date: day, seq, path, valid.

    Every step must hold the hash that the step below came to; the last must come to the root. A date
    without a root, or an event that is no longer held, is not valid.
    """
    own = events.select("seq", F.col("at").cast("date").alias("day"), _leaf(F.col("seq"), F.col("hash")).alias("_leaf"))
    x = proofs.join(own, ["day", "seq"], "left").join(roots.select("day", F.col("root").alias("_root")), "day", "left")

    def step(acc, p):
        return F.when(F.exists(p["children"], lambda k: (k["block"] == p["child"]) & (k["node"] == acc)), _node(p["children"]))

    reached = F.aggregate("path", F.col("_leaf"), step)
    return x.withColumn("valid", F.coalesce(reached == F.col("_root"), F.lit(False))).drop("_leaf", "_root")


def damaged_blocks(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Lowest blocks of sequence numbers whose hash differs from the stored tree's: CHANGED, MISSING (stored alone) or ADDED.

    Only hashes of blocks meet, a 64th of the events; intact blocks leave no row.
    """
    cols = ["day", "block", "node", "first_seq", "last_seq"]
    a, b = (x.where("level = 1").select(*cols) for x in (nodes, stored))
    both = a.alias("a").join(b.alias("b"), F.col("a.day").eqNullSafe(F.col("b.day")) & (F.col("a.block") == F.col("b.block")), "full")
    status = F.when(F.col("a.node").isNull(), "MISSING").when(F.col("b.node").isNull(), "ADDED").when(F.col("a.node") != F.col("b.node"), "CHANGED")
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("day", "block")]
    span = [F.least("a.first_seq", "b.first_seq").alias("first_seq"), F.greatest("a.last_seq", "b.last_seq").alias("last_seq")]
    return both.select(*pick, *span, status.alias("status")).where("status is not null")


def seal_mismatch(seals: DataFrame, stored: DataFrame) -> DataFrame:
    """Dates whose recomputed seal differs from the stored one or has no stored one."""
    s = stored.select("day", F.col("root").alias("_root"), F.col("last_seq").alias("_last"))
    x = seals.join(s, "day", "left")
    status = F.when(F.col("_root").isNull(), "UNSEALED").when((F.col("_root") != F.col("root")) | (F.col("_last") != F.col("last_seq")), "MISMATCH")
    return x.withColumn("status", status).where(F.col("status").isNotNull()).drop("_root", "_last")


def unsealed_dates(seals: DataFrame, stored: DataFrame, through: Column) -> DataFrame:
    return seals.where(F.col("day") <= through).join(stored.select("day"), "day", "left_anti").select("day", "events")


def legal(from_state: Column, to_state: Column) -> Column:
    """Whether the table allows a move; a literal map lookup, no join."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.element_at(table, from_state), to_state), F.lit(False))


def order_transition_audit(log: DataFrame, segment: Column) -> DataFrame:
    """Illegal moves, side conditions, repeated broker events and stale cumulative fills.

    ``log`` carries order_id, event_id, seq, state, side, reason, cum_qty. The state and the
    greatest fill before each row come from a segmented scan, so one long order is no hot task.
    """
    w = log.groupBy("event_id").agg(F.min("seq").alias("_first"))
    x = log.join(w, "event_id").withColumn("_dup", F.col("seq") > F.col("_first"))
    x = running(
        x, ["order_id"], ["seq"], segment,
        {
            "from_state": ("last", F.when(~F.col("_dup"), F.col("state"))),
            "_max": ("max", F.when(~F.col("_dup"), F.col("cum_qty"))),
        },
        exclusive=True,
    )
    known = F.col("from_state").isNotNull()
    ok = legal(F.col("from_state"), F.col("state"))
    filled = F.col("state").isin("PARTIALLY_FILLED", "FILLED")
    why = reasons(
        (F.col("_dup"), "DUPLICATE_EVENT"),
        (~F.col("_dup") & known & ~ok, "ILLEGAL_TRANSITION"),
        (~F.col("_dup") & known & ok & (F.col("from_state") == "UNKNOWN") & ~F.coalesce(F.col("reason").startswith("reconciliation:"), F.lit(False)), "RECONCILE_ONLY"),
        (~F.col("_dup") & known & ok & (F.col("from_state") == "FILLED") & (F.col("state") == "CLOSED") & (F.col("side") != "SELL"), "EXIT_ONLY"),
        (~F.col("_dup") & filled & (F.col("_max") > 0) & (F.col("cum_qty") <= F.col("_max")), "STALE_FILL"),
    )
    return x.withColumn("issues", why).drop("_first", "_dup", "_max")


def job_health(runs: DataFrame) -> DataFrame:
    """Latest run per job with missed and failed counts, in one partial aggregation."""
    last = F.max_by(F.struct("status", "finished_at"), F.struct("started_at", "run_id"))
    out = runs.groupBy("job").agg(
        last.alias("_l"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "MISSED").alias("missed"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )
    return out.select("job", F.col("_l.status").alias("last_status"), F.col("_l.finished_at").alias("last_finished"), "runs", "missed", "failed")


def source_coverage(obs: DataFrame) -> DataFrame:
    """Rows, span, last ingest and entities by source prefix."""
    return obs.groupBy(F.substring_index("source_id", ".", 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("available_at").alias("earliest"), F.max("available_at").alias("latest"),
        F.max("ingested_at").alias("last_ingested"), F.count_distinct("entity_id").alias("entities"), F.sum("bytes").alias("bytes"),
    )


def days_behind(latest: Column, now: Column) -> Column:
    return F.greatest(F.datediff(now, latest), F.lit(0))
