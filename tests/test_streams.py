"""Keyed streams against the batch rules: events out of order over several micro-batches, repeats, evicted state, timers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from knownwhen.operators import ledger
from knownwhen.streaming import jobs, keyed

START = dt.datetime(2024, 1, 1)
LOG = "order_id long, event_id string, seq long, state string, side string, reason string, cum_qty long, at timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, base, batches, schema, start):
    """Land each batch and drain what is there, restarting from the checkpoint every time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = jobs.drain(start(jobs.read_table(spark, f"{base}/in")), f"{base}/out", f"{base}/cp")
    return out


def state(spark, base, name, lists=False):
    r = spark.read.format("statestore").option("path", f"{base}/cp").option("stateVarName", name)
    return (r.option("flattenCollectionTypes", "true") if lists else r).load().count()


def order_rows(n, orders, seed):
    rng = random.Random(seed)
    states = [s for s in ledger.TRANSITIONS if s not in keyed.TERMINAL]
    rows = []
    for i in range(n):
        o = min(rng.randrange(orders * 2), orders - 1)  # the last order holds half of all events
        again = [r for r in rows if r[0] == o]
        event = rng.choice(again)[1] if again and rng.random() < 0.1 else f"e{i}"
        reason = rng.choice(["reconciliation: broker", "broker", None])
        rows.append((o, event, i, rng.choice(states), rng.choice(["BUY", "SELL", None]), reason, rng.choice([None, *range(5)]), at(i * 10)))
    return rows


def test_order_events_in_any_order_give_the_batch_audit(spark, tmp_path):
    rows, rng = order_rows(240, 5, 3), random.Random(4)
    late = sorted(rows, key=lambda r: r[2] * 10 + rng.uniform(0, 290))  # within the lateness of 300 seconds
    batches = [late[i : i + 60] for i in range(0, 240, 60)]
    batches.append([(99, "end", 0, "CREATED", "BUY", "x", 0, at(100_000))])
    got = run(spark, tmp_path, batches, LOG, lambda s: keyed.stream_order_audit(s, "300 seconds"))
    want = ledger.order_transition_audit(spark.createDataFrame(rows, LOG), F.floor(F.col("seq") / 50)).where(F.size("issues") > 0)
    want = {(r["seq"], r["from_state"], ",".join(sorted(r["issues"]))) for r in want.collect()}
    got = [(r["seq"], r["from_state"], ",".join(sorted(r["issues"].split(",")))) for r in got.collect()]
    assert len(got) == len(set(got)) and (set(got) - want, want - set(got)) == (set(), set())
    assert any("DUPLICATE_EVENT" in g[2] for g in got) and any("STALE_FILL" in g[2] for g in got)


def test_closed_orders_leave_the_state(spark, tmp_path):
    row = lambda o, e, s, to, t: (o, e, s, to, "SELL", "x", 0, at(t))
    batches = [
        [row(1, "a", 1, "CREATED", 0), row(2, "b", 1, "CREATED", 0), row(1, "c", 2, "REJECTED", 10)],
        [row(3, "d", 1, "CREATED", 2000), row(1, "c", 2, "REJECTED", 10)],  # the repeat arrives while the order is kept
        [row(3, "e", 2, "VALIDATED", 9000)],  # the timer of order 1 passes here
        [row(1, "a", 9, "CREATED", 9500), row(2, "f", 2, "VALIDATED", 5), row(2, "g", 0, "VALIDATED", 4), row(3, "h", 3, "REJECTED", 20_000)],
    ]
    start = lambda s: keyed.stream_order_audit(s, "60 seconds", "1 hour")
    run(spark, tmp_path, batches[:2], LOG, start)
    assert (state(spark, tmp_path, "last"), state(spark, tmp_path, "seen"), state(spark, tmp_path, "pending", True)) == (2, 3, 1)
    run(spark, tmp_path, batches[2:3], LOG, start)
    assert (state(spark, tmp_path, "last"), state(spark, tmp_path, "seen"), state(spark, tmp_path, "pending", True)) == (2, 2, 1)
    got = run(spark, tmp_path, batches[3:], LOG, start)
    # Order 1 starts anew; of order 2's two events behind the watermark the first in sequence comes too late.
    assert sorted(tuple(r) for r in got.collect()) == [(0, "CREATED", "LATE_EVENT"), (2, "REJECTED", "DUPLICATE_EVENT")]


def silences(times, limit, mark):
    """The alerts of one source by the plain rule, over all its arrivals in order."""
    out, times = [], sorted(times)
    for i, t in enumerate(times):
        gap = i and t - times[i - 1] >= limit
        if gap and t <= mark:
            out.append(("BACK", t, times[i - 1]))
        if (i + 1 == len(times) or times[i + 1] - t >= limit) and t + limit <= mark:
            out.append(("SILENT", t + limit, t))
    return out


def test_silent_sources_alert_by_timer(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), t * 50 + rng.randrange(50)) for t in range(160) if t % 40 < 25 or rng.random() < 0.2]
    rows += [("quiet", 30)] * 3  # sends once, thrice over, and never again
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 390))
    batches = [[(s, at(t)) for s, t in late[i::1][:40]] for i in range(0, len(late), 40)]
    batches[1].append(("a", None))
    batches.append([(None, at(9000))])
    got = run(spark, tmp_path, batches, "source_id string, ts timestamp", lambda s: keyed.stream_silence(s, "200 seconds", "400 seconds"))
    want = [(s, k, at(a), at(b)) for s in ("a", "b", "quiet") for k, a, b in silences([t for x, t in rows if x == s], 200, 8600)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert ("quiet", "SILENT", at(230), at(30)) in want and sum(w[1] == "BACK" for w in want) > 3


def test_no_events_no_rows(spark, tmp_path):
    empty = run(spark, tmp_path, [[]], LOG, lambda s: keyed.stream_order_audit(s, "1 hour"))
    assert empty.collect() == [] and empty.columns == ["seq", "from_state", "issues"]


def test_an_append_opens_only_the_parts_of_its_identities(spark, tmp_path):
    """All other parts of a growing store are unreadable here, and the append neither fails nor changes its answer."""
    columns = "id long, entity_id string, source_id string, source_locator string, effective_at timestamp, vintage_at timestamp, observed_at timestamp, available_at timestamp, value string, quality_flags array<string>, raw_content_hash string, parser_version string"
    fact = lambda i, value, e: (i, f"e{e}", "s", f"loc{e}", at(0), None, at(0), at(10), value, [], "sha256:" + "a" * 64, "p1")
    append = lambda rows, n: jobs.append_batch(spark.createDataFrame(rows, columns), f"{tmp_path}/store", f"{tmp_path}/rejected", n, parts=8)
    for n in range(3):
        append([fact(100 * n + e, f"v{n}", e) for e in range(40)], n)
    mine = spark.createDataFrame([fact(900, "v0", 7), fact(901, "v9", 7)], columns)
    part = mine.select(jobs._part(8)).first()["part"]
    folders = sorted((tmp_path / "store").glob("part=[0-9]*"))
    assert len(folders) == 8 and spark.read.parquet(f"{tmp_path}/store").count() == 120
    for folder in folders:
        if folder.name != f"part={part}":
            (folder / "part-broken.snappy.parquet").write_bytes(b"not a table")
    append(mine.collect(), 3)
    kept = spark.read.parquet(f"{tmp_path}/store/part={part}").where("entity_id = 'e7'").orderBy("id").collect()
    assert [(r["id"], r["quality_flags"]) for r in kept] == [(7, []), (107, ["CORRECTED"]), (207, ["CORRECTED"]), (901, ["CORRECTED"])]


class Memory:
    """The state of one key in memory, with the number of messages that a real one would take."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def _variable(self, empty, **methods):
        class Variable:
            value = empty()

        v = Variable()

        def counted(f):
            def call(*args):
                self.calls += 1
                return f(v, *args)

            return call

        for name, f in methods.items():
            setattr(v, name, counted(f))
        v.clear = counted(lambda v: setattr(v, "value", empty()))
        return v

    def getListState(self, *_):
        return self._variable(list, get=lambda v: iter(v.value), put=lambda v, x: setattr(v, "value", list(x)), appendList=lambda v, x: v.value.extend(x))

    def getMapState(self, *_):
        return self._variable(dict, containsKey=lambda v, k: k in v.value, updateValue=lambda v, k, x: v.value.update({k: x}))

    def getValueState(self, *_):
        return self._variable(tuple, exists=lambda v: bool(v.value), get=lambda v: v.value, update=lambda v, x: setattr(v, "value", x))


def audited(rows, step, listed=1024):
    """One order's events in batches of ``step``, the watermark at each batch's end; the issues and the messages."""
    import pandas as pd

    p, memory, out = keyed.OrderAudit(10**15), Memory(), []
    p.LISTED = listed
    p.init(memory)
    columns = ["seq", "event_id", "state", "side", "reason", "cum_qty", "at_us"]
    for i in range(0, len(rows), step):
        part = [(r[2], r[1], *r[3:7], r[2]) for r in rows[i : i + step]]
        mark = type("T", (), {"getCurrentWatermarkInMs": lambda self, n=part[-1][0]: n})()
        out += p.handleInputRows((1,), iter([pd.DataFrame(part, columns=columns)]), mark)
    return [tuple(r) for x in out for r in x.itertuples(index=False)], memory.calls, p


def test_messages_to_the_state_are_for_batches_not_events():
    rows = order_rows(3000, 1, 6)
    got, calls, _ = audited(rows, 1000)
    assert calls < 60 and any("DUPLICATE_EVENT" in g[2] for g in got)
    # Ids that moved to the index, because of small batches, give the same.
    few, _, p = audited(rows, 5, listed=300)
    assert few == got and p.index.value and not p.seen.value
