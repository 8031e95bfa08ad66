"""Parsers of landed price, macro, position, filing and holdings payloads.

Input is (path, content, raw_content_hash), one row per payload file; output is the
observation envelope and a table of rejected payloads. Everything is JSON, XML and
array functions of Spark; pages are bounded files, so windows inside one are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import first_true, ny_date
from knownwhen.operators import calendars as cal
from knownwhen.sources.envelope import drifted, envelope

BAR = "struct<t:string,o:double,h:double,l:double,c:double,v:double,n:bigint,vw:double>"
KEYED_BARS = f"bars map<string,array<{BAR}>>, next_page_token string"
DAILY = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,divCash:double,splitFactor:double>>"


def _instant(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def _bar_rows(rows: DataFrame, days: DataFrame, source: str, prefix: str) -> DataFrame:
    """Shared tail of the bar parsers: session times, stale flags, repeat locators.

    A bar off-session is stale and available with the next session's bar; a bar repeating
    the date before it in its page is stale and gets a numbered locator.
    """
    w = Window.partitionBy("path", "symbol").orderBy("pos")
    new = F.coalesce(F.col("session") != F.lag("session").over(w), F.lit(True))
    x = rows.withColumn("_run", F.sum(new.cast("int")).over(w))
    x = x.withColumn("_rep", F.row_number().over(Window.partitionBy("path", "symbol", "_run").orderBy("pos")) - 1)
    x = cal.on_day(x, days, F.col("session"))
    on = F.col("is_session")
    flags = F.array_distinct(
        F.array_compact(
            F.array(F.lit("AVAILABLE_AT_ESTIMATED"), F.when(~on | (F.col("_rep") > 0), F.lit("STALE_BAR")))
        )
    )
    suffix = F.when(F.col("_rep") > 0, F.concat(F.lit("#repeat"), "_rep")).otherwise("")
    return envelope(
        x,
        source_id=F.lit(source),
        locator=F.concat(F.lit(f"{prefix}/"), "symbol", F.lit("/"), F.col("session").cast("string"), suffix),
        entity=F.col("symbol"),
        observed_at=F.when(on, F.col("close_at")).otherwise(F.col("provider_at")),
        available_at=cal.bar_release(F.when(on, F.col("close_at")).otherwise(F.col("next_close_at"))),
        value=F.to_json(F.struct("close", "high", "low", "open", F.col("session").cast("string").alias("session"), "symbol", "volume")),
        flags=flags,
    )


def bars_keyed(payloads: DataFrame, days: DataFrame, source: str = "market.bars.1d") -> tuple[DataFrame, DataFrame]:
    """Pages ``{bars: {SYM: [{t, o, h, l, c, v}]}}``; the session is the New York date of ``t``."""
    doc = payloads.withColumn("d", F.from_json("content", KEYED_BARS))
    rows = doc.select("path", "raw_content_hash", F.col("d.bars").isNull().alias("_none"), F.explode_outer("d.bars").alias("key", "arr"))
    rows = rows.select("path", "raw_content_hash", "_none", F.upper("key").alias("symbol"), F.posexplode_outer("arr").alias("pos", "b"))
    at = _instant(F.col("b.t"))
    problem = first_true(
        (F.col("_none"), "no bars object"), (F.col("b").isNotNull() & (at.isNull() | F.col("b.c").isNull()), "bar without time or close")
    )
    good, bad = drifted(rows, problem)
    good = good.where(F.col("b").isNotNull()).select(
        "path", "raw_content_hash", "symbol", "pos", at.alias("provider_at"), ny_date(at).alias("session"), F.col("b.o").alias("open"),
        F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").cast("bigint").alias("volume"),
    )
    return _bar_rows(good, days, source, "bars/1d"), bad


def _daily(payloads: DataFrame) -> DataFrame:
    doc = payloads.withColumn("d", F.from_json("content", DAILY))
    rows = doc.select("path", "raw_content_hash", F.upper("symbol").alias("symbol"), F.col("d").isNull().alias("_none"), F.posexplode_outer("d").alias("pos", "b"))
    return rows.withColumn("session", F.try_to_date(F.substring("b.date", 1, 10)))


def bars_array(payloads: DataFrame, days: DataFrame, source: str = "market.eod.1d") -> tuple[DataFrame, DataFrame]:
    """Arrays ``[{date, open .. volume}]`` of one symbol; the session is the date text."""
    rows = _daily(payloads)
    problem = first_true(
        (F.col("_none"), "not an array of rows"), (F.col("b").isNotNull() & (F.col("session").isNull() | F.col("b.close").isNull()), "row without date or close")
    )
    good, bad = drifted(rows, problem)
    good = good.where(F.col("b").isNotNull()).select(
        "path", "raw_content_hash", "symbol", "pos", "session", F.col("session").cast("timestamp_ntz").alias("provider_at"),
        "b.open", "b.high", "b.low", "b.close", F.col("b.volume").cast("bigint").alias("volume"),
    )
    return _bar_rows(good, days, source, "eod/1d"), bad


def vendor_actions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dividends and splits of the daily rows, flagged as single-source.

    A negative dividend, a non-positive split or a repeated action rejects the payload.
    """
    rows = _daily(payloads)
    div, ratio = F.col("b.divCash"), F.col("b.splitFactor")
    acts = F.filter(
        F.array(
            F.struct(F.lit("CASH_DIVIDEND").alias("kind"), div.alias("amount"), (div > 0).alias("on")),
            F.struct(F.lit("SPLIT").alias("kind"), ratio.alias("amount"), (ratio != 1).alias("on")),
        ),
        lambda a: a["on"],
    )
    rows = rows.withColumn("a", F.explode_outer(acts))
    n = F.count(F.lit(1)).over(Window.partitionBy("path", "symbol", "session", "a.kind"))
    rows = rows.withColumn("_n", n)
    problem = first_true(
        (F.col("_none") | div.isNull() | ratio.isNull(), "missing divCash or splitFactor"),
        (div < 0, "negative divCash"),
        (ratio <= 0, "non-positive splitFactor"),
        (F.col("a").isNotNull() & (F.col("_n") > 1), "duplicate action"),
    )
    good, bad = drifted(rows, problem)
    good = good.where(F.col("a").isNotNull())
    out = envelope(
        good,
        source_id=F.concat(F.lit("corporate_action."), F.lower("a.kind")),
        locator=F.concat_ws("/", F.lit("corporate-actions"), "symbol", "a.kind", F.col("session").cast("string")),
        entity=F.col("symbol"),
        effective_at=F.col("session"),
        available_at=F.col("session"),
        value=F.to_json(F.struct(F.col("a.amount").alias("amount"), F.col("session").cast("string").alias("exDate"), F.col("a.kind").alias("kind"))),
        flags=F.array(F.lit("UNVERIFIED_SINGLE_SOURCE")),
    )
    return out, bad


MACRO = "realtime_start string, realtime_end string, observations array<struct<realtime_start:string,realtime_end:string,date:string,value:string>>"


def macro_vintages(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per (period, vintage); ``.`` is a missing value; released 08:30 New York of the vintage."""
    doc = payloads.withColumn("d", F.from_json("content", MACRO))
    rows = doc.select("path", "raw_content_hash", "series", "d.realtime_start", "d.realtime_end", F.col("d.observations").isNull().alias("_none"), F.explode_outer("d.observations").alias("o"))
    day, vintage = F.try_to_date("o.date"), F.try_to_date("o.realtime_start")
    number = F.when(F.trim("o.value") != ".", F.expr("try_cast(o.value as decimal(38,8))"))
    problem = first_true(
        (F.col("_none"), "no observations"),
        (F.col("o").isNotNull() & (day.isNull() | vintage.isNull()), "bad date"),
        ((F.trim("o.value") != ".") & number.isNull(), "bad value"),
    )
    good, bad = drifted(rows, problem)
    return envelope(
        good.where(F.col("o").isNotNull()),
        source_id=F.concat(F.lit("fred."), "series"),
        locator=F.concat_ws("/", F.lit("observations"), "series", "realtime_start", "realtime_end"),
        entity=F.col("series"),
        effective_at=day,
        vintage_at=vintage,
        available_at=cal.macro_release(vintage),
        value=number.cast("string"),
        flags=F.array(F.lit("AVAILABLE_AT_ESTIMATED")),
    ), bad


def vintage_windows(dates: DataFrame, size: int, by: str) -> DataFrame:
    """Request windows of at most ``size`` sorted dates that share their boundary dates.

    One row per distinct date and series; the place comes from a bounded window, the
    boundary rows are emitted for both windows they close and open.
    """
    w = Window.partitionBy(by).orderBy("vintage")
    x = dates.select(by, "vintage").distinct()
    x = x.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    step = size - 1
    own = F.floor(F.col("_i") / step)
    shared = (F.col("_i") > 0) & (F.col("_i") % step == 0)
    final = F.col("_i") == F.col("_n") - 1
    nos = F.when(shared & final, F.array(own - 1)).when(shared, F.array(own - 1, own)).otherwise(F.array(own))
    x = x.withColumn("window_no", F.explode(nos))
    return x.groupBy(by, "window_no").agg(
        F.min("vintage").alias("start"), F.max("vintage").alias("end"), F.count(F.lit(1)).alias("n")
    ).withColumn("shares_boundary", F.col("window_no") > 0)


# Fixed value: which columns of a positions row are figures.
POSITION_COLUMNS = (
    "^(open_interest|noncomm_|comm_|tot_rept_|nonrept_|prod_merc_|swap_|m_money_|other_rept_|dealer_|asset_mgr_|lev_money_"
    "|change_|pct_of_|traders_|conc_)"
)


def positions_wide(payloads: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Weekly positions with open-ended figure columns kept as a map; release by the Tuesday rule."""
    rows = payloads.withColumn("d", F.from_json("content", "array<map<string,string>>"))
    rows = rows.select("path", "raw_content_hash", F.col("d").isNull().alias("_none"), F.explode_outer("d").alias("m"))
    code, report = F.trim(F.col("m")["cftc_contract_market_code"]), F.try_to_date(F.substring(F.col("m")["report_date_as_yyyy_mm_dd"], 1, 10))
    rows = rows.withColumn("market", code).withColumn("report", report)
    figures = F.map_filter("m", lambda k, v: k.rlike(POSITION_COLUMNS) & v.isNotNull() & (v != ""))
    rows = rows.withColumn("figures", figures)
    odd = F.exists(F.map_values("figures"), lambda v: ~v.rlike(r"^-?\d+(\.\d+)?$"))
    problem = first_true((F.col("_none"), "not an array"), (F.col("market").isNull() | F.col("report").isNull(), "row without market or date"), (odd, "figure is not a number"))
    good, bad = drifted(rows, problem)
    good = cal.positions_release(good, "report")
    return envelope(
        good,
        source_id=F.lit(f"cftc.cot.{dataset}"),
        locator=F.concat_ws("/", F.lit("cot"), F.lit(dataset), "market", F.col("report").cast("string")),
        entity=F.col("market"),
        observed_at=F.col("report"),
        effective_at=F.col("report"),
        available_at=F.col("release_at"),
        value=F.to_json("figures"),
        flags=F.col("release_flags"),
    ), bad


def positions_long(observations: DataFrame) -> DataFrame:
    m = F.from_json("value", "map<string,decimal(38,8)>")
    return observations.select("entity_id", "effective_at", "available_at", F.explode(m).alias("figure", "amount"))


FILINGS = (
    "cik string, name string, filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,"
    "reportDate:array<string>,acceptanceDateTime:array<string>,form:array<string>>>"
)


def filing_index(payloads: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column-oriented filing lists as one row per filing; insider forms feed two sources.

    A report date after the filing date falls back to the filing date with a flag.
    """
    doc = payloads.withColumn("d", F.from_json("content", FILINGS)).withColumn("r", F.col("d.filings.recent"))
    sizes = F.array(*[F.size(f"r.{x}") for x in ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form")])
    doc = doc.withColumn("_even", F.size(F.array_distinct(sizes)) == 1)
    zipped = F.arrays_zip("r.accessionNumber", "r.filingDate", "r.reportDate", "r.acceptanceDateTime", "r.form")
    rows = doc.select("path", "raw_content_hash", F.lpad("d.cik", 10, "0").alias("cik"), "_even", F.col("r").isNull().alias("_none"), F.explode_outer(zipped).alias("f"))
    problem = first_true((F.col("_none") | F.col("cik").isNull(), "no filings"), (~F.col("_even"), "array lengths differ"))
    good, bad = drifted(rows, problem)
    good = good.where(F.col("f").isNotNull()).select(
        "path", "raw_content_hash", "cik", F.col("f.accessionNumber").alias("accession"), F.try_to_date("f.filingDate").alias("filed"),
        F.try_to_date(F.nullif("f.reportDate", F.lit(""))).alias("report"), _instant(F.col("f.acceptanceDateTime")).alias("accepted"), F.col("f.form").alias("form"),
    )
    good = cal.filing_release(good, "accepted", days)
    ahead = F.col("report") > F.col("filed")
    base = [F.when(F.col("after_hours"), F.lit("AFTER_HOURS_ACCEPTANCE")), F.when(F.col("form").endswith("/A"), F.lit("AMENDED"))]
    index = F.struct(
        F.lit("sec.edgar.submissions").alias("source"), F.when(ahead, F.col("filed")).otherwise(F.col("report")).alias("observed"),
        F.array_compact(F.array(*base, F.when(ahead, F.lit("FORWARD_DATED_REPORT")))).alias("flags"),
    )
    insider = F.struct(F.lit("sec.edgar.form4").alias("source"), F.col("filed").alias("observed"), F.array_compact(F.array(*base)).alias("flags"))
    both = F.when(F.col("form").isin("4", "4/A"), F.array(index, insider)).otherwise(F.array(index))
    x = good.withColumn("s", F.explode(both))
    return envelope(
        x,
        source_id=F.col("s.source"),
        locator=F.col("accession"),
        entity=F.concat(F.lit("CIK"), "cik"),
        observed_at=F.col("s.observed"),
        available_at=F.col("release_at"),
        value=F.to_json(F.struct(F.col("filed").cast("string").alias("filingDate"), "form", F.col("report").cast("string").alias("reportDate"))),
        flags=F.col("s.flags"),
    ), bad


_V = "struct<value:string>"
FORM4 = (
    "aff10b5One string, issuer struct<issuerCik:string,issuerTradingSymbol:string>, reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<securityTitle:{_V},transactionDate:{_V},aff10b5One:string,"
    f"transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{_V},transactionPricePerShare:{_V},"
    f"transactionAcquiredDisposedCode:{_V}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_V}>>>>"
)


def _flag(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def _form4_problem(x: Column) -> Column:
    side = x["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"]
    return F.when(x.isNotNull(), first_true(
        (F.try_to_date(x["transactionDate"]["value"]).isNull(), "missing transactionDate"),
        (x["transactionCoding"]["transactionCode"].isNull(), "missing transactionCode"),
        (x["transactionAmounts"]["transactionShares"]["value"].isNull(), "missing transactionShares"),
        (~F.coalesce(side.isin("A", "D"), F.lit(False)), "acquiredDisposed must be A or D"),
    ))


def form4_xml(payloads: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per non-derivative transaction of an ownership document; of joint owners the first counts.

    ``payloads`` also carries accession, accepted and form. The plan flag of a row wins over
    the document's.
    """
    doc = payloads.withColumn("d", F.from_xml("content", FORM4, {"ignoreSurroundingSpaces": "true"}))
    doc = doc.select(
        "path", "raw_content_hash", "accession", "accepted", "form", F.col("d.issuer.issuerCik").alias("cik"),
        F.lpad(F.get("d.reportingOwner", F.lit(0))["reportingOwnerId"]["rptOwnerCik"], 10, "0").alias("owner"), _flag(F.col("d.aff10b5One")).alias("_doc_plan"),
        F.col("d.nonDerivativeTable.nonDerivativeTransaction").alias("_rows"),
    )
    # A document says of itself whether it is whole, so no text is read again to leave out the rows of others.
    none = F.array().cast("array<string>")
    headless = F.when(F.col("cik").isNull() | F.col("owner").isNull(), "missing issuer or owner")
    found = F.concat(F.array(headless), F.when(headless.isNull(), F.coalesce(F.transform("_rows", _form4_problem), none)).otherwise(none))
    doc = doc.withColumn("problems", F.array_sort(F.array_distinct(F.array_compact(found))))
    bad = doc.where(F.size("problems") > 0).select("path", "problems", F.lit("SCHEMA_DRIFT").alias("code"))
    rows = doc.select(*[x for x in doc.columns if x not in ("_rows", "problems")], F.posexplode(F.when(F.size("problems") == 0, F.col("_rows"))).alias("pos", "x"))
    good = rows.where(F.col("x").isNotNull()).withColumn("traded", F.try_to_date("x.transactionDate.value"))
    side = F.col("x.transactionAmounts.transactionAcquiredDisposedCode.value")
    good = cal.insider_lag(good, "traded", "accepted", days)
    value = F.to_json(
        F.struct(
            side.alias("acquiredDisposed"), F.col("x.transactionCoding.transactionCode").alias("code"),
            F.coalesce(_flag(F.col("x.aff10b5One")), F.col("_doc_plan")).alias("is10b51"), "owner",
            F.col("x.transactionAmounts.transactionPricePerShare.value").alias("price"),
            F.col("x.transactionAmounts.transactionShares.value").alias("shares"),
        )
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("after_hours"), F.lit("AFTER_HOURS_ACCEPTANCE")), F.when(F.col("late"), F.lit("LATE_FILING")),
            F.when(F.col("form").endswith("/A"), F.lit("AMENDED")),
        )
    )
    return envelope(
        good,
        source_id=F.lit("sec.edgar.form4"),
        locator=F.concat("accession", F.lit("/nonDerivativeTransaction/"), F.col("pos") + 1),
        entity=F.concat(F.lit("CIK"), F.lpad("cik", 10, "0")),
        observed_at=F.col("traded"),
        available_at=F.col("release_at"),
        value=value,
        flags=flags,
    ), bad


def holdings(lines: DataFrame) -> DataFrame:
    """Exported holdings lines as one observation per fund and as-of date.

    Available and vintage are the fetch instant. A fund's report is one document, so its
    lines are one array.
    """
    g = lines.groupBy("fund", "as_of", "fetched_at", "raw_content_hash").agg(
        F.array_sort(F.collect_list(F.struct("symbol", F.col("weight").cast("string").alias("weight")))).alias("lines")
    )
    return envelope(
        g,
        source_id=F.concat(F.lit("etf_holdings."), F.lower("fund")),
        locator=F.concat_ws("/", F.lit("holdings"), "fund", F.col("as_of").cast("string")),
        entity=F.col("fund"),
        effective_at=F.col("as_of"),
        vintage_at=F.col("fetched_at"),
        available_at=F.col("fetched_at"),
        value=F.to_json(F.struct(F.col("as_of").cast("string").alias("asOf"), "lines")),
        flags=F.array().cast("array<string>"),
    )


def read_holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "fund string, as_of date, symbol string, weight decimal(18,8), fetched_at timestamp_ntz, raw_content_hash string"
    return spark.read.schema(schema).csv(path, header=True)


def ingest_summary(appended: DataFrame) -> DataFrame:
    """Per run: observations, repeats, conflicts, artifacts and source ids."""
    return appended.groupBy("run").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("outcome") == "deduplicated").alias("deduplicated"),
        F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.count_distinct("raw_content_hash").alias("artifacts"),
        F.array_sort(F.collect_set("source_id")).alias("sources"),
    )


def artifact_verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed hashes against the manifest: missing, mismatched or unregistered artifacts.

    Files are ``binaryFile`` rows (path, content): only the hash leaves the scan's stage.
    """
    got = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_got"), F.length("content").alias("bytes"))
    x = manifest.join(got, "path", "full_outer")
    status = first_true(
        (F.col("_got").isNull(), "MISSING"), (F.col("raw_content_hash").isNull(), "UNREGISTERED"), (F.col("_got") != F.col("raw_content_hash"), "MISMATCH"),
        default=F.lit("OK"),
    )
    return x.withColumn("status", status).drop("_got")


def verify_window(manifest: DataFrame, run_no: int, windows: int) -> DataFrame:
    """The part of the manifest a run checks; successive runs rotate over all of it."""
    return manifest.where(F.pmod(F.xxhash64("path"), F.lit(windows)) == run_no % windows)


def ingest_span(splits: DataFrame, members: DataFrame, warmup_days: int = 1095) -> DataFrame:
    """Symbols and the date span a configuration needs: earliest window less the warm-up to the latest end."""
    lo, hi = splits.agg(F.min("eval_start")).scalar(), splits.agg(F.max("eval_end")).scalar()
    return members.select("entity_id").distinct().withColumn("from_date", F.date_sub(lo, warmup_days)).withColumn("to_date", hi)
