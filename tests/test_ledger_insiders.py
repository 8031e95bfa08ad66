"""Hash trees against a plain tree, insider clusters against daily counting."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from knownwhen.operators import insiders as ins
from knownwhen.operators import ledger as lg

D = dt.date
EVENTS = "seq long, at timestamp, hash string"
TRADES = "issuer long, owner long, accepted date, traded date, value decimal(18,2)"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(rows):
    """Root over (seq, hash) of one date, level by level."""
    nodes = {seq: sha(f"0|{seq}|{h or ''}") for seq, h in rows}
    for level in range(1, lg.DEPTH + 1):
        up = {}
        for block, node in sorted(nodes.items()):
            up.setdefault(0 if level == lg.DEPTH else block // lg.FANOUT, []).append((block, node))
        nodes = {b: k[0][1] if len(k) == 1 else sha("1" + ",".join(f"{x}:{n}" for x, n in k)) for b, k in up.items()}
    return nodes[0]


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(5)
    seqs = sorted(rng.sample(range(9000), 1500)) + [9_000_000, 2**40]
    rows = [(s, dt.datetime(2024, 1, 1 + i * 3 // len(seqs), 5), None if i == 7 else sha(f"e{s}")) for i, s in enumerate(seqs)]
    rows.append((2**40 + 1, dt.datetime(2024, 1, 9), "alone"))
    return rows, spark.createDataFrame(rows, EVENTS).repartition(5)


def test_merkle_roots(spark, ledger):
    rows, events = ledger
    got = {r["day"]: r for r in lg.merkle_seals(events).collect()}
    for day in {r[1].date() for r in rows}:
        mine = [(s, h) for s, at, h in rows if at.date() == day]
        assert got[day]["root"] == plain_root(mine)
        assert (got[day]["first_seq"], got[day]["last_seq"], got[day]["events"]) == (mine[0][0], mine[-1][0], len(mine))
    assert got[D(2024, 1, 9)]["root"] == sha(f"0|{2**40 + 1}|alone")
    # No group below the topmost level is wider than the fan-out, whatever a date holds.
    assert lg.merkle_nodes(events).where(F.col("level") < lg.DEPTH).agg(F.max(F.size("children"))).first()[0] <= lg.FANOUT
    assert lg.merkle_seals(events.limit(0)).count() == 0


def test_merkle_proofs_and_damage(spark, ledger):
    rows, events = ledger
    nodes = lg.merkle_nodes(events)
    roots = lg.merkle_seals(events)
    asked = events.select(F.col("at").cast("date").alias("day"), "seq")
    proofs = lg.inclusion_proofs(nodes, asked.unionByName(asked.limit(3)))
    assert proofs.count() == len(rows)
    assert lg.verify_proofs(proofs, events, roots).where("not valid").count() == 0
    # An altered event fails alone; a foreign one has no proof; a date without a root proves nothing.
    bad = rows[400][0]
    changed = events.withColumn("hash", F.when(F.col("seq") == bad, "x").otherwise(F.col("hash")))
    assert [r["seq"] for r in lg.verify_proofs(proofs, changed, roots).where("not valid").collect()] == [bad]
    assert lg.inclusion_proofs(nodes, asked.limit(1).withColumn("seq", F.lit(123456789).cast("long"))).count() == 0
    assert lg.verify_proofs(proofs, events, roots.limit(0)).where("valid").count() == 0
    forged = F.transform("path", lambda p: F.when(p["level"] == 1, F.struct(p["level"], p["child"], F.slice(p["children"], 1, 1).alias("children"))).otherwise(p))
    assert lg.verify_proofs(proofs.where(F.size(F.col("path")[0]["children"]) > 1).withColumn("path", forged), events, roots).where("valid").count() == 0
    hurt = lg.damaged_blocks(lg.merkle_nodes(changed), nodes).collect()
    assert [(r["block"], r["status"]) for r in hurt] == [(bad // lg.FANOUT, "CHANGED")]
    gone = lg.damaged_blocks(lg.merkle_nodes(events.where(F.col("seq") < 9000)), nodes)
    assert {(r["first_seq"], r["status"]) for r in gone.collect()} == {(9_000_000, "MISSING"), (2**40, "MISSING"), (2**40 + 1, "MISSING")}


def plain_clusters(buys, sales):
    def active(rows, issuer, day):
        return [r for r in rows if r[0] == issuer and max(r[2], r[3]) <= day <= r[3] + dt.timedelta(ins.WINDOW_DAYS)]

    out = []
    for issuer in sorted({b[0] for b in buys}):
        last = None
        for n in range(400):
            day = D(2024, 1, 1) + dt.timedelta(n)
            on = active(buys, issuer, day)
            owners, value = {b[1] for b in on}, sum(b[4] for b in on)
            ok = len(owners) >= 2 and value >= ins.MIN_CLUSTER and not active(sales, issuer, day)
            if ok and (last is None or (day - last).days >= ins.SPACING_DAYS):
                last = day
                later = [b for b in buys if b[0] == issuer and 0 < (max(b[2], b[3]) - day).days < ins.SPACING_DAYS]
                out.append((issuer, day, len(owners), float(value), len(later)))
    return out


def clusters(spark, buys, sales):
    got = ins.insider_cluster(spark.createDataFrame(buys, TRADES), spark.createDataFrame(sales, TRADES)).orderBy("issuer", "day").collect()
    return [(r["issuer"], r["day"], r["owners"], float(r["value"]), r["reinforcing"]) for r in got]


def trade(issuer, owner, day, amount, lag=0):
    from decimal import Decimal

    at = D(2024, 1, 1) + dt.timedelta(day)
    return (issuer, owner, at, at - dt.timedelta(lag), Decimal(amount))


def test_cluster_spacing(spark):
    # Owner 1 buys twice within the window and counts once; the second owner opens the cluster on day 10.
    buys = [trade(1, 1, 0, 60_000), trade(1, 1, 5, 60_000), trade(1, 2, 10, 30_000)]
    assert clusters(spark, buys, []) == [(1, D(2024, 1, 11), 2, 150_000.0, 0)]
    # Held up to day 100, the condition fires again exactly on the 90th day after the first event.
    more = buys + [trade(1, o, d, 80_000) for d in (80, 99, 100) for o in (3, 4)]
    assert [r[1] for r in clusters(spark, more, [])] == [D(2024, 1, 11), D(2024, 1, 11) + dt.timedelta(90)]
    # A sale within the window holds the event back until it has aged out.
    assert clusters(spark, [trade(1, 1, 20, 60_000), trade(1, 2, 20, 60_000)], [trade(1, 9, 0, 30_000)]) == [(1, D(2024, 2, 1), 2, 120_000.0, 0)]
    assert clusters(spark, [], []) == []


def test_clusters_by_brute_force(spark):
    rng = random.Random(11)
    buys = [trade(1 if rng.random() < 0.4 else rng.randrange(2, 6), rng.randrange(4), rng.randrange(330), rng.choice([25_000, 40_000, 90_000]), rng.randrange(11)) for _ in range(220)]
    buys += buys[:5]
    sales = [trade(rng.randrange(1, 6), rng.randrange(4), rng.randrange(330), 30_000, rng.randrange(40)) for _ in range(15)]
    want = plain_clusters(buys, sales)
    assert len(want) > 8 and clusters(spark, buys, sales) == want


def test_qualifying(spark):
    base = dict(issuer=1, owner=2, code="P", acquired="A", price=10.0, shares=2500.0, officer=True, director=False, plan=False, traded=D(2024, 1, 1), accepted=D(2024, 1, 11))
    odd = [{}, {"plan": None}, {"officer": None, "director": True}, {"officer": False}, {"officer": None, "director": None}, {"plan": True}, {"shares": 2499.0},
           {"price": None}, {"acquired": "D"}, {"accepted": D(2024, 1, 12)}, {"owner": None}, {"code": "S"}, {"traded": None}]
    rows = spark.createDataFrame([tuple({**base, **o}.values()) for o in odd], "issuer long, owner long, code string, acquired string, price double, shares double, officer boolean, director boolean, plan boolean, traded date, accepted date")
    assert ins.qualifying(rows, "P").count() == 3
    assert ins.qualifying(rows, "S").count() == 1
