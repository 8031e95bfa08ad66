"""Work that must grow no faster than the input."""


import datetime as dt
import random

from pyspark.sql import functions as F

from knownwhen.operators import calendars, controls, evaluation, executions, insiders, pit
from knownwhen.operators import identity as ident
from knownwhen.sources import feeds


def test_estimates_of_chains_do_not_multiply(spark):
    """Long tails into a ring, a long rooted chain: right totals, and a plan whose estimate has not been squared round by round."""
    parents = {i: i - 1 for i in range(1, 200)} | {0: None, 300: 301, 301: 302, 302: 300} | {i: i - 1 if i > 400 else 300 for i in range(400, 500)}
    e = spark.createDataFrame(list(parents.items()), "experiment long, parent long")
    t = spark.createDataFrame([(k, k) for k in parents], "experiment long, trial_id long")
    out = evaluation.trial_chain_count(e, t)
    got = {r[0]: (r["chain_trials"], r["state"]) for r in out.collect()}
    want = {i: (i + 1, "ROOTED") for i in range(200)} | {i: (3, "CYCLE") for i in (300, 301, 302)} | {i: (3 + i - 399, "CYCLE") for i in range(400, 500)}
    assert got == want
    assert float(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1e12


def test_symbols_are_resolved_by_dates(spark):
    """Against every pair of a request and a range; the ranges meet requests on calendar buckets, not on the symbol alone."""
    rnd, day = random.Random(5), lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    at = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(n, 3600)
    ranges = []
    for i in range(150):
        a = rnd.randrange(300)
        to = rnd.choice([None, a + rnd.randrange(-1, 90)])
        ranges.append((rnd.choice("xyz"), i % 40, day(a), None if to is None else day(to), at(a + rnd.randrange(5)), None if to is None or i % 9 == 0 else at(to + rnd.randrange(40))))
    asks = [(i, rnd.choice(["x", "y", "z", "none", None]), day(rnd.randrange(400)), at(rnd.randrange(420))) for i in range(300)]
    r = spark.createDataFrame(ranges, "symbol string, entity_id long, effective_from date, effective_to date, known_from timestamp_ntz, close_known_from timestamp_ntz")
    q = spark.createDataFrame(asks, "k long, symbol string, on_date date, known_at timestamp_ntz")
    out = ident.resolve_symbol(q, r, "k")

    def entity(symbol, on, known):
        hit = {e for s, e, a, b, k, c in ranges if s == symbol and a <= on and k <= known and (b is None or b >= on or c is not None and c > known)}
        return hit.pop() if len(hit) == 1 else None

    assert {x["k"]: x["entity_id"] for x in out.collect()} == {k: entity(s, o, n) for k, s, o, n in asks}
    assert "_bucket" in out._jdf.queryExecution().toString()


def shuffled(spark) -> int:
    executors = spark._jsparkSession.sparkContext().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_lot_moves_once(spark, tmp_path):
    n = F.col("id")
    fills = spark.range(20_000).select(
        F.sha2(n.cast("string"), 256).alias("fill_id"), (n % 2).alias("account"), F.lit("A").alias("entity_id"), F.when(n % 4 < 2, "BUY").otherwise("SELL").alias("side"),
        (n % 7 + 1).alias("qty"), (n % 11 + 10.0).alias("price"), F.date_add(F.lit("2024-01-01").cast("date"), (n / 50).cast("int")).alias("session"), F.lit(0.0).alias("fee"),
    )
    fills.write.parquet(f"{tmp_path}/fills")
    splits = spark.createDataFrame([], "entity_id string, effective_date date, ratio double")
    before = shuffled(spark)
    executions.lot_match_fifo(spark.read.parquet(f"{tmp_path}/fills"), splits).write.parquet(f"{tmp_path}/out")
    assert (shuffled(spark) - before) / 20_000 < 230


def test_conflicting_pairs_are_not_moved_again(spark, tmp_path):
    """Against every pair, with several ranges of an entity, empty ranges and starts on one day; the pairs of single ranges stay in their join."""
    rnd, day = random.Random(7), lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(n)
    ranges = []
    for i in range(260):
        a = rnd.randrange(60)
        ranges.append((rnd.choice("xyz"), rnd.randrange(90), day(a), day(rnd.choice([None, a + rnd.randrange(-2, 25)]))))
    schema = "symbol string, entity_id long, effective_from date, effective_to date"
    want = {}
    for s, e, a, b in ranges:
        for s2, e2, a2, b2 in ranges:
            if s == s2 and e != e2 and (a < a2 and b is not None and b >= a2 or a == a2 and (b is None or b >= a2)):
                want.setdefault((s, a2, min(e, e2), max(e, e2)), set()).add(a)
    got = ident.range_conflicts(spark.createDataFrame(ranges, schema)).collect()
    assert len(got) == len(want) and {(r[0], r[1], r[2], r[3]): r["held_from"] for r in got} == {k: min(v) for k, v in want.items()}

    n = F.col("id")
    day0 = F.lit("2020-01-01").cast("date")
    spark.range(1400).select(F.lit("x").alias("symbol"), n.alias("entity_id"), F.date_add(day0, n.cast("int")).alias("effective_from"), F.date_add(day0, 1400).alias("effective_to")).write.parquet(f"{tmp_path}/r")
    before = shuffled(spark)
    ident.range_conflicts(spark.read.parquet(f"{tmp_path}/r")).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1400 * 1399 // 2
    assert shuffled(spark) - before < 2_000_000


def test_facts_of_packets_move_once_a_month_not_once_a_decision(spark, tmp_path):
    n, start = F.col("id"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(F.lit(0), F.lit(0), (n % 40_000).cast("int"))
    obs = spark.range(20_000).select(
        "id", F.concat(F.lit("s"), n % 3).alias("source_id"), F.concat(F.lit("l"), n % 5).alias("source_locator"), (n % 700).cast("string").alias("entity_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), (n % 97).cast("int")).cast("timestamp_ntz").alias("effective_at"), at.alias("available_at"), F.when(n % 2 == 0, at).alias("vintage_at"),
        (n * 7919 % 1000).alias("value"), F.when(n % 31 == 0, F.array(F.lit("ARTIFACT_MISSING"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )
    obs.write.parquet(f"{tmp_path}/obs")
    obs = spark.read.parquet(f"{tmp_path}/obs")
    days = spark.range(40).select((start + F.make_dt_interval(n.cast("int"))).alias("decision_at"))

    def packets(name, by, keys):
        before = shuffled(spark)
        facts = pit.asof_latest(obs, days, F.lit(60), by=by) if by else pit.asof_latest(obs, days, F.lit(60))
        out = controls.evidence_packets(facts.withColumn("raw_content_hash", F.sha2(F.col("value").cast("string"), 256)), keys)
        out.select("decision_at", "entity_id", "packet_hash").write.parquet(f"{tmp_path}/{name}")
        return {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}, shuffled(spark) - before

    got, moved = packets("dealt", ["entity_id"], ["decision_at", "decision_month", "entity_id"])
    want, spread = packets("plain", None, ["decision_at", "entity_id"])
    assert got == want and len(got) > 20_000
    assert moved * 3 < spread
    empty = pit.asof_latest(obs, days.where("false"), F.lit(60), by=["entity_id"])
    assert empty.count() == 0


def test_versions_of_an_append_move_few_bytes(spark, tmp_path, monkeypatch):
    """Outcomes against a plain loop, with many and with few identities; fewer than 260 bytes a row are moved."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def rows(ids, idents, hashes):
        n = F.col("id")
        return ids.select(
            "id", F.lit("s").alias("source_id"), F.concat(F.lit("loc-"), F.sha2((n * 7919 % idents).cast("string"), 256)).alias("source_locator"), F.lit("e").alias("entity_id"),
            at.alias("effective_at"), at.alias("vintage_at"), F.lit("p1").alias("parser_version"), F.array(F.lit("STALE")).alias("quality_flags"),
            F.concat(F.lit("sha256:"), F.sha2((n * 104729 % hashes).cast("string"), 256)).alias("value_hash"),
        )

    batch, stored = rows(spark.range(3000), 200, 9), rows(spark.range(5000, 5300), 900, 9)
    kept = {(r["source_locator"], r["value_hash"]) for r in stored.collect()}
    known, want, taken = {k[0] for k in kept}, {}, set(kept)
    for r in batch.orderBy("id").collect():
        k = (r["source_locator"], r["value_hash"])
        want[r["id"]] = "deduplicated" if k in taken else "conflict" if k[0] in known else "inserted"
        taken.add(k)
        known.add(k[0])
    assert set(want.values()) == {"deduplicated", "conflict", "inserted"}
    for bound in (200_000, 0):
        monkeypatch.setattr(pit, "SMALL_ROWS", bound, raising=False)
        out = pit.append_outcome(batch, stored).collect()
        assert len(out) == 3000 and {r["id"]: r["outcome"] for r in out} == want
        assert all(r["quality_flags"] == (["CORRECTED", "STALE"] if r["outcome"] == "conflict" else ["STALE"]) for r in out)

    rows(spark.range(20_000), 20_000, 20_000).write.parquet(f"{tmp_path}/rows")
    many = spark.read.parquet(f"{tmp_path}/rows")
    before = shuffled(spark)
    pit.append_outcome(many, many.where("false")).select("id", "outcome").write.parquet(f"{tmp_path}/out")
    assert (shuffled(spark) - before) / 20_000 < 260


def test_form4_documents_are_read_once(spark):
    """Rows of whole documents, the problems of others, and one reading of each text."""
    amount = lambda side: f"<transactionAmounts><transactionShares><value>5</value></transactionShares><transactionAcquiredDisposedCode><value>{side}</value></transactionAcquiredDisposedCode></transactionAmounts>"
    tx = lambda date, side="A": f"<nonDerivativeTransaction>{date and f'<transactionDate><value>{date}</value></transactionDate>'}<transactionCoding><transactionCode>P</transactionCode></transactionCoding>{amount(side)}</nonDerivativeTransaction>"
    who = "<reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId></reportingOwner>"
    doc = lambda body, owner=who: f"<ownershipDocument><issuer><issuerCik>9</issuerCik></issuer>{owner}<nonDerivativeTable>{body}</nonDerivativeTable></ownershipDocument>"
    docs = {
        "a": doc(tx("2024-01-03") + tx("2024-01-04", "D")), "b": doc(tx("2024-01-03") + tx("") + tx("2024-01-03", "X")), "c": doc(tx("2024-01-03"), ""), "d": doc(""), "e": doc(tx("2024-01-05")),
    }
    read = spark.sparkContext.accumulator(0)

    def content(path):
        read.add(1)
        return docs[path]

    rows = spark.createDataFrame([(k, f"A{k}", dt.datetime(2024, 1, 5, 12), "4") for k in docs], "path string, accession string, accepted timestamp_ntz, form string").repartition(1)
    rows = rows.withColumn("content", F.udf(content, "string")("path")).withColumn("raw_content_hash", F.lit("h"))
    days = calendars.day_table(spark.range(1).select(F.lit("2023-12-01").cast("date").alias("first"), F.lit("2024-03-01").cast("date").alias("last")))
    good, bad = feeds.form4_xml(rows, days)
    assert sorted(r[0] for r in good.select("source_locator").collect()) == [f"A{x}" for x in ("a/nonDerivativeTransaction/1", "a/nonDerivativeTransaction/2", "e/nonDerivativeTransaction/1")]
    assert read.value == len(docs)
    want = [("b", ["acquiredDisposed must be A or D", "missing transactionDate"], "SCHEMA_DRIFT"), ("c", ["missing issuer or owner"], "SCHEMA_DRIFT")]
    assert sorted(tuple(r) for r in bad.select("path", "problems", "code").collect()) == want


def test_trades_of_clusters_are_worked_out_once(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [("i", o, day(t), day(t + 2)) for o in "ab" for t in (0, 5, 40, 130)]
    read = spark.sparkContext.accumulator(0)

    def value(owner):
        read.add(1)
        return 60_000

    p = spark.createDataFrame(rows, "issuer string, owner string, traded date, accepted date").repartition(1).withColumn("value", F.udf(value, "long")("owner"))
    out = insiders.insider_cluster(p, p.where("false")).collect()
    assert sorted((r["day"], r["owners"], r["value"], r["reinforcing"]) for r in out) == [(day(2), 2, 120_000, 4), (day(132), 2, 120_000, 0)]
    assert read.value == len(rows)
