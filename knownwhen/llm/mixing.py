"""Mixing sources to target weights by iterative proportional fitting, in DataFrame and SQL functions.

Tokens are summed by cell (source, language, topic). The cells' weights are raked to the target
share of each source, then language, then topic, over and over. What a cell's weight has become
against its tokens is how willingly its documents are drawn. A budget, a share of all tokens, is
raked: no cell gives more than it has, and what a full cell or value can't give is raked over the
rest, so that small cells don't shrink the others. Without one, the most willing cell is drawn
whole and the others in proportion, so the drawn tokens have the raked mix exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import Rounds, materialise, prepare, unused

DIMENSIONS = ("source", "lang", "topic")
#: The target share of a value is in proportion to this power of its tokens: 1 keeps the mix, 0 levels it.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
ROUNDS = 10
#: The share of all tokens that is drawn.
BUDGET = 0.8
#: A topic is the first of these kinds that a text's content shows, else prose.
TOPICS = (("legal", "licen"), ("contact", "@"), ("table", " | "))


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, sign in reversed(TOPICS):
        out = F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(sign)), F.lit(name)).otherwise(out)
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, tokens) with weight: raked to the targets (value, share) of each dimension."""
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    out, tables = cells.withColumn("weight", F.col("tokens").cast("double")), Rounds(cells.sparkSession)
    for _ in range(rounds):
        for dim, target in targets.items():
            # Sums by value are aggregated before they are shuffled; Spark broadcasts them below its own bound on bytes.
            factor = out.groupBy(dim).agg(F.sum("weight").alias("now")).join(target, dim, "left")
            factor = factor.select(dim, F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("now")).otherwise(0.0).alias("factor"))
            # The weights are read twice, by the sums and by the product; written down, they are worked out once.
            out = tables.write(out.join(factor, dim).select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("factor")).alias("weight")))
    return out


def tempered(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """Targets in proportion to a power of each value's tokens."""
    out = {}
    for dim, power in powers.items():
        raised = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).select(dim, F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(power))).otherwise(0.0).alias("raised"))
        all_ = raised.agg(F.coalesce(F.sum("raised"), F.lit(0.0))).first()[0] or 1.0
        out[dim] = materialise(raised.select(dim, (F.col("raised") / all_).alias("share")))
    return out


def within(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> dict[str, DataFrame]:
    """Target tokens (value, target) of each dimension: shares of the budget; what a value lacks falls to the others in proportion."""
    held, most = {}, budget * (cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    for dim, target in targets.items():
        of = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).join(target, dim, "left")
        held[dim] = materialise(of.select(dim, "n", F.coalesce("share", F.lit(0.0)).alias("share")))
        most = min(most, held[dim].agg(F.coalesce(F.sum(F.when(F.col("share") > 0, F.col("n"))), F.lit(0))).first()[0])
    out = {}
    for dim, values in held.items():
        scale, full = most, None
        while True:
            is_full = F.col("share") * scale >= F.col("n")
            n, count, rest = values.filter("share > 0").agg(F.coalesce(F.sum(F.when(is_full, F.col("n"))), F.lit(0)), F.count(F.when(is_full, True)), F.coalesce(F.sum(F.when(~is_full, F.col("share"))), F.lit(0.0))).first()
            # Values that are full stay so, as the scale only grows.
            if count == full or not rest:
                break
            scale, full = max(scale, (most - n) / rest), count
        out[dim] = materialise(values.select(dim, F.when(F.col("share") > 0, F.least(F.col("share") * scale, F.col("n").cast("double"))).otherwise(0.0).alias("target")))
    return out


def rake_within(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with weight, at most the tokens of a cell: raked to the targets (value, share) of the budget."""
    out, tables = cells.withColumn("weight", F.col("tokens") * F.lit(float(budget))), Rounds(cells.sparkSession)
    bounds = within(cells, targets, budget)
    for _ in range(rounds):
        for dim, target in bounds.items():
            is_full = F.col("weight") >= F.col("tokens")
            sums = out.groupBy(dim).agg(F.sum("weight").alias("now"), F.coalesce(F.sum(F.when(is_full, F.col("weight"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)).alias("open"))
            sums = sums.join(target, dim)
            # Too much: all cells give in proportion. Too little: the full ones can't give more, the others do.
            factor = F.when(F.col("now") >= F.col("target"), F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0))
            factor = factor.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")).otherwise(1.0)
            factor = sums.select(dim, factor.alias("factor"), (F.col("now") < F.col("target")).alias("more"))
            given = F.when(F.col("more") & is_full, F.col("weight")).otherwise(F.least(F.col("weight") * F.col("factor"), F.col("tokens").cast("double")))
            out = tables.write(out.join(factor, dim).select(*DIMENSIONS, "tokens", given.alias("weight")))
    return out


def drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, topic: Column | None = None, budget: float | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns more: n_tokens, weight, probability, kept under the names returned.

    ``budget``: the share of all tokens to draw; None: as many as the most willing cell allows.
    """
    prepare(docs.sparkSession)
    names = dict(zip(("n_tokens", "weight", "probability", "kept", *DIMENSIONS), unused(docs, "n_tokens", "weight", "probability", "kept", "cell_source", "cell_lang", "cell_topic"), strict=True))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    keyed = docs.withColumns({names["source"]: value("source"), names["lang"]: value("lang"), names["topic"]: topic_of(F.col("text")) if topic is None else topic, names["n_tokens"]: tokens_of(F.col("text"))})
    cells = keyed.groupBy(*[F.col(names[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(names["n_tokens"]).alias("tokens"))
    cells = materialise(cells)
    targets = targets or tempered(cells)
    raked = rake(cells, targets, rounds) if budget is None else rake_within(cells, targets, budget, rounds)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    most = (raked.agg(F.max(ratio)).first()[0] or 1.0) if budget is None else 1.0
    # A cell without tokens changes no mix: it stays whole.
    chance = raked.select(*[F.col(d).alias(names[d]) for d in DIMENSIONS], F.round(F.coalesce(ratio, F.lit(1.0)), 6).alias(names["weight"]), F.round(F.coalesce(ratio / most, F.lit(1.0)), 6).alias(names["probability"]))
    # Some hundred cells for some hundred sources; joins of large cells are split by adaptive execution.
    out = keyed.join(chance, [names[d] for d in DIMENSIONS])
    uniform = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 12), 16, 10).cast("long") / float(1 << 48)
    return out.withColumn(names["kept"], uniform < F.col(names["probability"])), names


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, budget: float | None = BUDGET) -> DataFrame:
    """Returns doc_id, topic, n_tokens long, weight, probability double, kept boolean: a row for each row of ``docs``.

    ``targets``: source, lang, topic to a table (value, share); by default tempered shares. Null or missing
    sources and languages are a value of their own, the empty one; null texts have no tokens. Documents of
    cells without tokens have probability 1; other documents of a value that the targets lack have probability 0,
    and are returned. ``budget``: the share of all tokens to draw, or None, see drawn(). The draw hangs on doc_id
    alone, so that repeated rows share it. An empty table gives an empty result.
    """
    out, names = drawn(docs, targets, rounds, budget=budget)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(names[n]).alias(n) for n in ("topic", "n_tokens", "weight", "probability", "kept")])


def _sql() -> str:
    topic = "case " + " ".join(f"when contains(coalesce(text, ''), '{sign}') then '{name}'" for name, sign in TOPICS) + " else 'prose' end"
    steps = [
        f"""keyed as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, {topic} as topic,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens from documents)""",
        "cells as (select source, lang, topic, sum(n_tokens) as tokens from keyed group by all)",
    ]
    for dim, power in POWERS.items():
        steps.append(f"target_{dim} as (select {dim}, r / nullif(sum(r) over (), 0) as share from (select {dim}, case when sum(tokens) > 0 then pow(cast(sum(tokens) as double), {power}) else 0.0 end as r from cells group by all))")
    for dim in DIMENSIONS:
        # Values in the order in which they are used up: the first k give all they have, the others their share of the rest.
        steps.append(f"held_{dim} as (select c.{dim}, sum(tokens) as n, any_value(share) as share from cells c join target_{dim} t on t.{dim} = c.{dim} group by 1)")
    most = "least(" + ", ".join([f"{BUDGET} * (select sum(tokens) from cells)", *[f"(select sum(n) from held_{dim} where share > 0)" for dim in DIMENSIONS]]) + ")"
    for dim in DIMENSIONS:
        steps.append(f"order_{dim} as (select *, sum(n) over w - n as n_before, sum(share) over w - share as share_before, row_number() over (order by n / share, {dim}) as k from held_{dim} where share > 0 window w as (order by n / share, {dim} rows unbounded preceding))")
        steps.append(f"scale_{dim} as (select arg_min(({most} - n_before) / nullif(1 - share_before, 0), k) as scale from order_{dim} where n >= share * ({most} - n_before) / nullif(1 - share_before, 0))")
        steps.append(f"bound_{dim} as (select {dim}, case when share > 0 then least(share * coalesce((select scale from scale_{dim}), 1e300), n) else 0 end as target from held_{dim})")
    last, weight = "cells", f"cast(tokens as double) * {BUDGET}"
    for i in range(ROUNDS):
        for dim in DIMENSIONS:
            steps.append(f"""s{i}_{dim} as (select c.source, c.lang, c.topic, tokens, {weight} as weight, target, sum({weight}) over v as now,
  coalesce(sum({weight}) filter ({weight} >= tokens) over v, 0) as held, coalesce(sum({weight}) filter ({weight} < tokens) over v, 0) as open
  from {last} c join bound_{dim} t on t.{dim} = c.{dim} window v as (partition by c.{dim}))""")
            steps.append(f"""r{i}_{dim} as (select source, lang, topic, tokens, case when now < target and weight >= tokens then weight else least(weight * case
  when now >= target then case when now > 0 then target / now else 0 end when open > 0 then (target - held) / open else 1 end, tokens) end as weight from s{i}_{dim})""")
            last, weight = f"r{i}_{dim}", "weight"
    return f"""with {", ".join(steps)}
select doc_id, topic, n_tokens, round(coalesce(ratio, 1.0), 6) as weight, round(coalesce(ratio, 1.0), 6) as probability,
  cast(('0x' || substr(sha256(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) / 281474976710656.0 < round(coalesce(ratio, 1.0), 6) as kept
from keyed join (select *, case when tokens > 0 then weight / tokens end as ratio from {last}) using (source, lang, topic)"""


SQL = _sql()
