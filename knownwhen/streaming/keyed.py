"""State processors: one key's buffers and timers, kept in RocksDB and checkpointed to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from knownwhen.operators.ledger import TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = frozenset(s for s, onward in TRANSITIONS.items() if not onward)


def clocked(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """A stream with a watermark on ``time`` whose rows carry the time as microseconds, ``at_us``, instead.

    The watermark drives the timers; as the processor's rows no longer hold the marked column, Spark
    drops none of them as late, and the processor says what becomes of them. Rows without a time are due at once.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = stream.withWatermark(time, lateness)
    return marked.withColumn("at_us", F.coalesce(F.unix_micros(time), F.lit(0))).drop(time)


def micros(stream: DataFrame, length: str) -> int:
    """A constant length of time such as "30 days", in microseconds."""
    one = stream.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {length}")))
    return one.first()[0]


def _now(timer_values) -> int:
    return timer_values.getCurrentWatermarkInMs() * 1000


def _wake(handle: StatefulProcessorHandle, us: int) -> None:
    """A timer at the first millisecond that is not before ``us``; Spark fires those up to the watermark."""
    handle.registerTimer(-(-us // 1000))


def _plain(x: pd.Series) -> list:
    """Python values; whole numbers with gaps come as floats and are whole again."""
    if x.dtype.kind in "iu":
        return x.tolist()
    if x.dtype.kind == "f":
        return [None if v != v else int(v) for v in x.tolist()]
    return [None if v is None or v is pd.NA or v != v else v for v in x.tolist()]


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [row for b in batches for row in zip(*[_plain(b[c]) for c in columns])]


class OrderAudit(StatefulProcessor):
    """Issues of one order's events, taken in sequence however they arrive.

    An event waits in ``pending`` until the watermark reaches it and every waiting event with a smaller
    number; a timer stands at the earliest such moment. ``seen`` holds the ids of the events taken,
    ``last`` the state, the greatest cumulative fill, the newest number and its time. All three are
    deleted ``keep_us`` after a terminal state; an event beyond that starts anew, in whatever batch it comes.

    Every call to the state is a message to the JVM, so there are a few of them a batch and not some for each event: waiting
    events are rows of arrays, ``CHUNK`` events long, and ``seen`` is a list that is read and extended whole. Only an
    order with more than ``LISTED`` ids, of which a batch brings less than one in ``FEW``, has its ids moved to
    ``index`` and looked up one by one. ``listed`` is the length of the list, -1 once it has moved.
    """

    FIELDS = "seq bigint, event_id string, state string, side string, reason string, cum_qty bigint, at_us bigint"
    COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]
    CHUNKS = ", ".join("{} array<{}>".format(*f.split()) for f in FIELDS.split(", "))
    OUT = "seq bigint, from_state string, issues string"
    CHUNK, LISTED, FEW = 1024, 1024, 40

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.CHUNKS)
        self.seen = handle.getListState("seen", "event_id string")
        self.index = handle.getMapState("index", "event_id string", "here boolean")
        self.last = handle.getValueState("last", "state string, cum bigint, seq bigint, at_us bigint, listed bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._advance(_rows(rows, self.COLUMNS), _now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance([], _now(timerValues))

    def close(self) -> None:
        pass

    def _advance(self, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        old = [e for chunk in self.pending.get() for e in zip(*chunk)]
        waiting = sorted([*old, *new], key=lambda e: (e[0], e[6]))
        due = next((i for i, e in enumerate(waiting) if e[6] > now), len(waiting))
        out = self._take(waiting[:due])
        left = waiting[due:]
        if left:
            self.pending.put([tuple(list(x) for x in zip(*left[i : i + self.CHUNK])) for i in range(0, len(left), self.CHUNK)])
            _wake(self.handle, left[0][6])
        else:
            if old:
                self.pending.clear()
            self._evict(now)
        if out:
            yield pd.DataFrame(out, columns=["seq", "from_state", "issues"])

    def _seen_of(self, ids: set[str], listed: int) -> tuple[set[str], int]:
        """Which ids were taken before, among them all of ``ids`` that were, and the length of the list."""
        if listed > self.LISTED and len(ids) * self.FEW < listed:
            for e in list(self.seen.get()):
                self.index.updateValue(e, (True,))
            self.seen.clear()
            listed = -1
        if listed < 0:
            return {i for i in ids if self.index.containsKey((i,))}, listed
        return {e[0] for e in self.seen.get()} if listed else set(), listed

    def _forget(self, listed: int) -> None:
        (self.index if listed < 0 else self.seen).clear()

    def _take(self, events: list[tuple]) -> list[tuple]:
        if not events:
            return []
        state, cum, newest, at, listed = self.last.get() if self.last.exists() else (None, None, None, None, 0)
        seen, listed = self._seen_of({e[1] for e in events if e[1] is not None}, listed)
        out, fresh = [], []
        for seq, event_id, to, side, reason, qty, at_us in events:
            if state in TERMINAL and at_us > at + self.keep_us:
                state = cum = newest = at = None
                self._forget(listed)
                seen, fresh, listed = set(), [], 0
            if event_id is not None and event_id in seen:
                out.append((seq, state, "DUPLICATE_EVENT"))
                continue
            if event_id is not None:
                seen.add(event_id)
                fresh.append((event_id,))
            if newest is not None and seq < newest:
                out.append((seq, state, "LATE_EVENT"))
                continue
            why = _issues(state, cum, to, side, reason, qty)
            if why:
                out.append((seq, state, ",".join(why)))
            state, newest, at = to or state, seq, at_us if at is None else max(at, at_us)
            cum = qty if cum is None else cum if qty is None else max(cum, qty)
        if listed < 0:
            for e in fresh:
                self.index.updateValue(e, (True,))
        elif fresh:
            self.seen.appendList(fresh)
            listed += len(fresh)
        self.last.update((state, cum, newest, at, listed))
        return out

    def _evict(self, now: int) -> None:
        if not self.last.exists():
            return
        state, _, _, at, listed = self.last.get()
        if state in TERMINAL:
            if at + self.keep_us <= now:
                self._forget(listed)
                self.last.clear()
            else:
                _wake(self.handle, at + self.keep_us)


def _issues(state, cum, to, side, reason, qty) -> list[str]:
    """What the audit of the whole log says of one event. A missing state is an illegal move, a missing reason is no reconciliation."""
    why = []
    if state is not None and to not in TRANSITIONS.get(state, ()):
        why.append("ILLEGAL_TRANSITION")
    elif state == "UNKNOWN" and not (reason or "").startswith("reconciliation:"):
        why.append("RECONCILE_ONLY")
    elif state == "FILLED" and to == "CLOSED" and side is not None and side != "SELL":
        why.append("EXIT_ONLY")
    if to in ("PARTIALLY_FILLED", "FILLED") and cum is not None and qty is not None and 0 < cum and qty <= cum:
        why.append("STALE_FILL")
    return why


def stream_order_audit(events: DataFrame, lateness: str, keep: str = "30 days") -> DataFrame:
    """The order-log audit on arriving events (order_id, event_id, seq, state, side, reason, cum_qty, at).

    Events of one order may arrive in any order within the lateness; their numbers rise with their times, and an
    event id belongs to one order. A repeated id is labelled ``DUPLICATE_EVENT``; an event that comes after
    a later one has been taken is labelled ``LATE_EVENT`` and moves nothing. The state of a closed order
    is deleted ``keep`` after its end. Numbers must not be null; a null id is never a repeat.
    """
    rows = events.select("order_id", *OrderAudit.COLUMNS[:-1], F.col("at").cast("timestamp").alias("at"))
    processor = OrderAudit(micros(events, keep))
    return clocked(rows, "at", lateness).groupBy("order_id").transformWithStateInPandas(processor, OrderAudit.OUT, "Append", "EventTime")


class Silence(StatefulProcessor):
    """When one source falls silent and when it is back.

    ``spans`` holds stretches of arrivals less than the limit apart that are not yet settled, at most as many as
    limits fit into the lateness; ``seen`` the newest settled arrival and whether its silence has been told.
    A timer stands at the end of the limit, so a source that sends nothing more is told of without a row of its own.
    """

    OUT = "source_id string, kind string, at_us bigint, last_us bigint"

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first_us bigint, last_us bigint")
        self.seen = handle.getValueState("seen", "last_us bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [s for b in rows for s in self._spans(b["at_us"].to_numpy())]
        yield self._advance(key[0], spans, _now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], [], _now(timerValues))

    def close(self) -> None:
        pass

    def _spans(self, times: np.ndarray) -> list[tuple[int, int]]:
        times = np.sort(times)
        cut = np.flatnonzero(np.diff(times) >= self.limit_us)
        return list(zip(times[np.r_[0, cut + 1]].tolist(), times[np.r_[cut, -1]].tolist()))

    def _advance(self, source: str, new: list[tuple[int, int]], now: int) -> pd.DataFrame:
        spans: list[list[int]] = []
        for first, last in sorted([*self.spans.get(), *new]):
            if spans and first - spans[-1][1] < self.limit_us:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last])
        seen, told = self.seen.get() if self.seen.exists() else (None, True)
        out = []
        while True:
            if not told and spans and spans[0][0] - seen < self.limit_us:
                seen = max(seen, spans.pop(0)[1])
            elif not told and seen + self.limit_us <= now:
                out.append((source, "SILENT", seen + self.limit_us, seen))
                told = True
            elif told and spans and seen is not None and spans[0][1] <= seen:
                spans.pop(0)
            elif told and spans and spans[0][0] <= now:
                first, last = spans.pop(0)
                if seen is not None:
                    out.append((source, "BACK", max(first, seen), seen))
                seen, told = last, False
            else:
                break
        if seen is not None:
            self.seen.update((seen, told))
        if spans:
            self.spans.put([tuple(s) for s in spans])
        else:
            self.spans.clear()
        if not told:
            _wake(self.handle, seen + self.limit_us)
        elif spans:
            _wake(self.handle, spans[0][0])
        return pd.DataFrame(out, columns=["source_id", "kind", "at_us", "last_us"])


def stream_silence(arrivals: DataFrame, limit: str, lateness: str) -> DataFrame:
    """Alerts of sources (source_id, ts): ``SILENT`` told at the end of the limit after the last arrival, ``BACK`` at the next one.

    Arrivals may be out of order within the lateness. One that is later changes nothing, unless it is newer than all
    that was settled. Arrivals without a time say nothing. A source is known from its first arrival on.
    """
    rows = arrivals.where("ts is not null").select(F.col("source_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    told = clocked(rows, "ts", lateness).groupBy("source_id").transformWithStateInPandas(Silence(micros(arrivals, limit)), Silence.OUT, "Append", "EventTime")
    return told.select("source_id", "kind", F.timestamp_micros("at_us").alias("told_at"), F.timestamp_micros("last_us").alias("last_seen"))
