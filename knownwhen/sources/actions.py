"""Corporate-action files: validation, signed files, curated tables, issuer lists, NAV histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import first_true, reasons, sha256_text, text_array
from knownwhen.sources.envelope import envelope

# The fields each kind of action reads.
FIELDS = {
    "SPLIT": ("entityId", "exDate", "kind", "ratio"),
    "CASH_DIVIDEND": ("amount", "entityId", "exDate", "kind", "payDate", "qualified"),
    "SYMBOL_CHANGE": ("effective", "entityId", "kind", "newSymbol", "oldSymbol"),
    "MERGER": ("acquirer", "effective", "entityId", "kind", "terms"),
    "SPINOFF": ("child", "childFirstClose", "childSymbol", "exDate", "kind", "parent", "ratio"),
    "DELISTING": ("entityId", "finalPrice", "kind", "lastTradeDate", "reason"),
    "STALE_BAR": ("entityId", "kind", "reason", "session"),
    "CORRECTED_BAR": ("close", "entityId", "high", "kind", "low", "open", "priorHash", "session", "volume"),
}
TERMINAL = ("MERGER", "DELISTING")


def action_problems(a: Column) -> Column:
    """Reasons an action map (field -> text) is malformed, unread or cannot be valued."""

    def text(k: str) -> Column:
        return a[k]

    def num(k: str) -> Column:
        return text(k).try_cast("decimal(38,12)")

    def day(k: str) -> Column:
        return F.try_to_date(text(k))

    kind = a["kind"]
    known = F.coalesce(kind.isin(*FIELDS), F.lit(False))
    dotted = {"MERGER": ("terms.cashPerShare", "terms.stockRatio")}
    read = F.create_map(*[x for k, f in FIELDS.items() for x in (F.lit(k), text_array([*f, *dotted.get(k, ())]))])
    given = F.map_keys(F.map_filter(a, lambda k, v: v.isNotNull()))
    dates = {k: next(x for x in ("exDate", "effective", "lastTradeDate", "session") if x in f) for k, f in FIELDS.items()}
    when = a[F.element_at(F.create_map(*[x for k, f in dates.items() for x in (F.lit(k), F.lit(f))]), kind)]
    who = F.when(kind == "SPINOFF", text("parent")).otherwise(text("entityId"))
    cases = [
        (~known, "UNKNOWN_KIND"),
        (known & (F.size(F.array_except(given, F.element_at(read, kind))) > 0), "UNREAD_FIELD"),
        (known & (F.coalesce(F.length(who), F.lit(0)) == 0), "NO_ENTITY"),
        (known & F.try_to_date(when).isNull(), "BAD_DATE"),
    ]
    cases += [
        (kind.isin("SPLIT", "SPINOFF") & ~F.coalesce(num("ratio") > 0, F.lit(False)), "BAD_RATIO"),
        ((kind == "CASH_DIVIDEND") & ~F.coalesce(num("amount") >= 0, F.lit(False)), "BAD_AMOUNT"),
        ((kind == "CASH_DIVIDEND") & ~F.coalesce(day("payDate") >= day("exDate"), F.lit(False)), "PAY_BEFORE_EX"),
        ((kind == "SYMBOL_CHANGE") & (text("oldSymbol").isNull() | text("newSymbol").isNull()), "NO_SYMBOL"),
        ((kind == "MERGER") & text("terms.cashPerShare").isNull() & text("terms.stockRatio").isNull(), "NO_TERMS"),
        ((kind == "MERGER") & F.coalesce(num("terms.cashPerShare") < 0, F.lit(False)), "BAD_AMOUNT"),
        ((kind == "SPINOFF") & text("childFirstClose").isNotNull() & ~F.coalesce(num("childFirstClose") > 0, F.lit(False)), "BAD_AMOUNT"),
        ((kind == "DELISTING") & F.coalesce(num("finalPrice") < 0, F.lit(False)), "BAD_AMOUNT"),
        ((kind == "SPINOFF") & text("childFirstClose").isNull(), "UNVALUED_SPINOFF"),
        ((kind == "MERGER") & text("terms.stockRatio").isNotNull(), "UNVALUED_STOCK_MERGER"),
        ((kind == "DELISTING") & text("finalPrice").isNull(), "UNVALUED_DELISTING"),
    ]
    return F.array_distinct(reasons(*cases))


def validate_actions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("problems", action_problems(F.col("action")))


SIGNED = (
    "dataset string, approval struct<approvedBy:string,approvedAt:string,actionsHash:string>, "
    "actions array<struct<action:map<string,string>,announcedAt:string,sources:array<string>>>"
)


def _effective(a: Column) -> Column:
    return F.try_to_date(F.coalesce(a["exDate"], a["effective"], a["lastTradeDate"], a["session"]))


def actions_hash(actions: Column) -> Column:
    """Hash of an actions list with every map written in sorted key order."""

    def one(e: Column) -> Column:
        pairs = F.transform(F.array_sort(F.map_entries(e["action"])), lambda kv: F.concat(kv["key"], F.lit("="), F.coalesce(kv["value"], F.lit(""))))
        return F.concat_ws("|", F.array_join(pairs, "&"), F.coalesce(e["announcedAt"], F.lit("")), F.array_join(e["sources"], ","))

    return sha256_text(F.array_join(F.transform(actions, one), ";"))


def reconciled_file(payloads: DataFrame, ingested_at: Column) -> tuple[DataFrame, DataFrame]:
    """Signed action files as observations; one problem refuses the whole file.

    Refused: unsigned or changed after signing, malformed or unvaluable actions, two terminal
    actions of an entity, actions past its series end, repeats.
    """
    doc = payloads.withColumn("d", F.from_json("content", SIGNED))
    signed = F.try_to_timestamp("d.approval.approvedAt").cast("timestamp_ntz")
    head = reasons(
        (F.col("d.actions").isNull(), "NOT_A_FILE"),
        (F.coalesce(F.trim("d.approval.approvedBy"), F.lit("")) == "", "UNSIGNED"),
        (signed.isNull(), "NO_APPROVAL_TIME"),
        (signed > ingested_at, "APPROVED_AFTER_INGEST"),
        (F.coalesce(actions_hash(F.col("d.actions")) != F.col("d.approval.actionsHash"), F.lit(True)), "CHANGED_AFTER_APPROVAL"),
    )
    doc = doc.withColumn("_head", head)
    rows = doc.select("path", "raw_content_hash", "_head", F.col("d.dataset").alias("dataset"), F.posexplode_outer("d.actions").alias("pos", "e"))
    a = F.col("e.action")
    rows = (
        rows.withColumn("kind", a["kind"])
        .withColumn("entity", F.coalesce(a["parent"], a["entityId"]))
        .withColumn("effective", _effective(a))
    )
    ends = Window.partitionBy("path", "entity")
    term = F.col("kind").isin(*TERMINAL)
    last = F.when(F.col("kind") == "MERGER", F.date_sub("effective", 1)).when(F.col("kind") == "DELISTING", F.col("effective"))
    rows = rows.withColumn("_ends", F.count(F.when(term, 1)).over(ends)).withColumn("_last", F.min(last).over(ends))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path", "entity", "kind", "effective")))
    body = reasons(
        (F.col("_ends") > 1, "TWO_TERMINAL_ACTIONS"),
        (F.col("kind").isin("CASH_DIVIDEND", "SPLIT", "SPINOFF") & (F.col("effective") > F.col("_last")), "AFTER_SERIES_END"),
        (F.col("_n") > 1, "DUPLICATE_ACTION"),
    )
    rows = rows.withColumn("_why", F.array_distinct(F.concat("_head", F.when(F.col("e").isNotNull(), F.concat(action_problems(a), body)).otherwise(F.array().cast("array<string>")))))
    bad = rows.where(F.size("_why") > 0).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_why")))).alias("problems"))
    good = rows.join(bad.select("path"), "path", "left_anti").where(F.col("e").isNotNull())
    start = F.col("effective").cast("timestamp_ntz")
    announced = F.try_to_timestamp("e.announcedAt").cast("timestamp_ntz")
    lone = F.size(F.array_distinct("e.sources")) < 2
    out = envelope(
        good,
        source_id=F.concat(F.lit("corporate_action."), F.lower("kind")),
        locator=F.concat_ws("/", F.lit("vendor/corporate-actions"), "dataset", "entity", "kind", F.col("effective").cast("string")),
        entity=F.col("entity"),
        effective_at=F.col("effective"),
        available_at=F.greatest(F.coalesce(announced, start), start),
        value=F.to_json("e.action"),
        flags=F.array_compact(F.array(F.when(lone, F.lit("UNVERIFIED_SINGLE_SOURCE")))),
    )
    return out, bad


CURATED = ("source", "entity", "kind", "ex_date", "value", "pay_date", "document")


def read_curated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curated rows as text, comments skipped, quoted commas kept; judged by ``curated_problems``."""
    schema = ", ".join(f"{c} string" for c in CURATED)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, comment="#", quote='"', escape='"', multiLine=True)


def curated_problems(rows: DataFrame, automated: tuple[str, ...] = ()) -> DataFrame:
    """Every problem of every line, not only the first; a repeated key is a problem of the later lines.

    ``rows`` carries a line number beside the text columns.
    """

    def t(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit(""))

    iso = r"^\d{4}-\d{2}-\d{2}$"
    ex, pay = F.when(t("ex_date").rlike(iso), F.try_to_date(t("ex_date"))), F.when(t("pay_date").rlike(iso), F.try_to_date(t("pay_date")))
    kind = t("kind")
    bad_source = ~t("source").rlike(r"^(issuer|exchange):[a-z0-9][a-z0-9-]*$")
    own = reasons(
        (bad_source, "BAD_SOURCE"),
        (~bad_source & t("source").isin(*automated) if automated else F.lit(False), "RESERVED_SOURCE"),
        (~F.upper(t("entity")).rlike(r"^[A-Z][A-Z.-]{0,9}$"), "BAD_ENTITY"),
        (~kind.isin("CASH_DIVIDEND", "SPLIT"), "BAD_KIND"),
        (ex.isNull(), "BAD_EX_DATE"),
        (~t("value").rlike(r"^\d+(\.\d+)?$") | F.coalesce(t("value").try_cast("decimal(38,12)") <= 0, F.lit(True)), "BAD_VALUE"),
        ((t("pay_date") != "") & (kind == "SPLIT"), "SPLIT_HAS_PAY_DATE"),
        ((t("pay_date") != "") & (kind != "SPLIT") & pay.isNull(), "BAD_PAY_DATE"),
        ((kind != "SPLIT") & (pay < ex), "PAY_BEFORE_EX"),
        (t("document") == "", "NO_DOCUMENT"),
    )
    x = rows.withColumn("problems", own).withColumn("_key", F.concat_ws("|", t("source"), F.upper(t("entity")), kind, t("ex_date")))
    first = x.where(F.size("problems") == 0).groupBy("_key").agg(F.min("line").alias("_first"))
    x = x.join(first, "_key", "left")
    again = (F.size("problems") == 0) & (F.col("line") > F.col("_first"))
    return x.withColumn("problems", F.when(again, F.array(F.lit("DUPLICATE"))).otherwise(F.col("problems"))).drop("_key", "_first")


STRUCTURAL = "actions array<struct<action:map<string,string>,sources:array<string>,supersedes:array<struct<source:string,kind:string,exDate:string>>,keeps:array<struct<source:string,kind:string,exDate:string>>>>"


def structural_entries(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated spin-offs, mergers and delistings, and the selectors they carry.

    A selector without a date means the action's own date.
    """
    doc = payloads.withColumn("d", F.from_json("content", STRUCTURAL))
    rows = doc.select("path", F.posexplode("d.actions").alias("pos", "e"))
    a = F.col("e.action")
    rows = rows.select(
        "path", "pos", F.coalesce(a["parent"], a["entityId"]).alias("entity_id"), a["kind"].alias("kind"), _effective(a).alias("ex_date"),
        action_problems(a).alias("problems"), F.size(F.array_distinct("e.sources")).alias("n_sources"), "e.supersedes", "e.keeps",
    )
    ends = F.when(F.col("kind") == "MERGER", F.date_sub("ex_date", 1)).when(F.col("kind") == "DELISTING", F.col("ex_date"))
    entries = rows.withColumn("last_date", ends).drop("supersedes", "keeps")

    def tag(c: str) -> Column:
        none = F.array().cast("array<struct<source:string,kind:string,exDate:string>>")
        return F.transform(F.coalesce(c, none), lambda s: F.struct(s["source"].alias("source"), s["kind"].alias("kind"), s["exDate"].alias("exDate"), F.lit(c).alias("choice")))

    sel = rows.select("entity_id", F.col("ex_date").alias("day"), F.explode(F.concat(tag("supersedes"), tag("keeps"))).alias("s"))
    selectors = sel.select("entity_id", "s.source", "s.kind", F.coalesce(F.try_to_date("s.exDate"), "day").alias("ex_date"), "s.choice", "day")
    return entries, selectors


def distributions_by_ex_date(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distribution components summed per fund and ex-date; zero totals are no distribution.

    A component listed twice on a date is refused. A pay date before the ex-date is dropped.
    """
    one = rows.groupBy("entity_id", "ex_date", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.max("pay_date").alias("pay_date")
    )
    twice = one.where("n > 1").select("entity_id", "ex_date", "component", "n")
    total = one.groupBy("entity_id", "ex_date").agg(
        F.sum("amount").alias("amount"), F.max("pay_date").alias("pay_date"), F.max("n").alias("_n"), F.count(F.lit(1)).alias("components")
    )
    ok = total.where((F.col("_n") == 1) & (F.col("amount") != 0)).drop("_n")
    return ok.withColumn("pay_date", F.when(F.col("pay_date") >= F.col("ex_date"), F.col("pay_date"))), twice


# Jump bounds, match bands and the standard split ratios looked for.
JUMP_UP, JUMP_DOWN, NAV_BAND, SHARES_BAND = 1.25, 0.8, 0.15, 0.05
STANDARD_RATIOS = (10.0, 5.0, 4.0, 3.0, 2.0, 1.5, 0.5, 0.25, 0.2, 0.1)


def split_detect(nav: DataFrame, days: DataFrame, ratios: tuple[float, ...] = STANDARD_RATIOS) -> DataFrame:
    """Jumps of a NAV history between neighbouring rows: a split, another jump, or a gap.

    A split needs adjacent sessions and exactly one standard ratio matched by both the NAV
    and the share count.
    """
    w = Window.partitionBy("entity_id").orderBy("session")
    idx = days.select(F.col("day").alias("session"), F.col("session_idx").alias("_i"), "is_session")
    x = nav.join(F.broadcast(idx), "session")
    for c in ("session", "nav", "shares", "_i", "is_session"):
        x = x.withColumn(f"_p_{c}", F.lag(c).over(w))
    x = x.where(F.col("_p_session").isNotNull())
    here = F.when(F.col("is_session"), 1).otherwise(0)
    x = x.withColumn("sessions_missing", F.col("_i") - F.col("_p__i") - here)
    x = x.withColumn("nav_ratio", F.col("_p_nav") / F.col("nav")).withColumn("shares_ratio", F.col("shares") / F.col("_p_shares"))
    jump = ~((F.col("nav_ratio") < JUMP_UP) & (F.col("nav_ratio") > JUMP_DOWN))
    near = F.filter(
        F.array(*[F.lit(float(r)) for r in ratios]),
        lambda r: (F.abs(F.col("nav_ratio") / r - 1) <= NAV_BAND) & (F.abs(F.col("shares_ratio") / r - 1) <= SHARES_BAND),
    )
    adjacent = (F.col("sessions_missing") == 0) & F.col("is_session") & F.col("_p_is_session")
    x = x.withColumn("_hits", F.when(jump & adjacent & F.col("shares_ratio").isNotNull(), near))
    ratio = F.when(F.size("_hits") == 1, F.element_at("_hits", 1))
    finding = first_true((ratio.isNotNull(), "SPLIT"), (jump, "JUMP"), (F.col("sessions_missing") > 0, "GAP"))
    out = x.withColumn("ratio", ratio).withColumn("finding", finding).where(F.col("finding").isNotNull())
    return out.select("entity_id", F.col("_p_session").alias("previous"), "session", "finding", "ratio", "nav_ratio", "shares_ratio", "sessions_missing")


def non_sessions(nav: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a NAV history dated off-session."""
    off = days.where(~F.col("is_session")).select(F.col("day").alias("session"))
    return nav.join(F.broadcast(off), "session", "left_semi").select("entity_id", "session")
