"""Personal data by proposed spans and boosted trees, in DataFrame and SQL functions.

Strict patterns with checks give base spans, which always stay. Looser patterns propose more and
overlapping ones. Boosted trees score a proposal by its format and its surroundings. They learn from
proposals that coincide with a checked base span against those that fail their kind's check; a
proposal that only a loose form finds and whose check passes is neither, and is scored by trees that
have not seen it. No feature tells the strict from the loose way of writing. All proposals of the corpus
are counted by their binned features in one aggregation; the trees are grown from these counts, whose number is
bounded by the product of the bins, and run as one SQL expression. A threshold for each kind,
calibrated for precision, selects what else is redacted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import doc_texts, materialise, prepare

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns in possessive form: the same matches without backtracking or deep recursion. A match begins
#: where a run of its first class begins, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its base pattern to be worth running.
QUICK = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: High-recall generators.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9][\x20()./0-9-]{6,22}[0-9](?![0-9])",
}
LOOSE_QUICK = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9] ?\. ?[0-9]{1,3} ?\. ?[0-9]", "card": r"[0-9](?:[\x20.-]{0,2}[0-9]){12}", "phone": r"[0-9][\x20()./0-9-]{6}"}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|account|pay", "phone": "phone|tel|call|fax|mobile|contact"}
#: Bins of a proposal's digits (without a leading 00): the least count of each.
DIGITS = (0, 1, 7, 9, 13, 16, 17, 20)
FEATURES = ("kind", "digits", "before", "after", "passes", "context")
ROUNDS, SHRINK, LEAST = 24, 0.4, 1.0
PRECISION = 0.95


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _passes(kind: str, m: str) -> str:
    """SQL: whether a match passes its kind's check."""
    if kind == "ip":
        return f"forall(split(translate({m}, ' ', ''), '[.]'), o -> char_length(trim(leading '0' from o)) <= 3 and coalesce(try_cast(trim(leading '0' from o) as int), 0) <= 255) and not {m} rlike '[0-9][.] | [.][0-9]'"
    if kind == "card":
        digits = f"translate({m}, ' -.', '')"
        digit = "cast(substring(c, i, 1) as int)"
        total = f"aggregate(sequence(1, char_length(c)), 0L, (s, i) -> s + case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)"
        luhn = f"exists(array(reverse({digits})), c -> {total} % 10 = 0)"
        return f"case when char_length({digits}) between 13 and 19 then {luhn} else false end"
    if kind == "phone":
        # A number written without + is one only if it says so: with 00 or an area code in brackets.
        return f"char_length(regexp_replace({m}, '^00|[^0-9]', '')) between 9 and 15 and {m} rlike '^(?:[+]|00[1-9]|[(](?:0[0-9]+|[2-9][0-9][0-9])[)])'"
    return f"({m} rlike '[.\\\\])][ ]?[A-Za-z][A-Za-z0-9-]*$' and not {m} rlike '[.] ')"


def _matches(kind: str, pattern: str, quick: str, name: str) -> list[Column]:
    """The matches of a pattern and the pieces of text around them."""
    some = f"text rlike {_quoted(quick)}"
    return [
        F.expr(f"case when {some} then regexp_extract_all(text, {_quoted(pattern)}, 0) else array() end").alias(f"{name}_m"),
        F.expr(f"case when {some} then split(text, {_quoted(pattern)}, -1) else array() end").alias(f"{name}_p"),
    ]


def _ends(name: str) -> Column:
    """Where each match ends, in code points."""
    steps = f"transform({name}_m, (m, i) -> char_length({name}_p[i]) + char_length(m))"
    return F.expr(f"aggregate({steps}, cast(array() as array<int>), (acc, x) -> array_append(acc, coalesce(try_element_at(acc, -1), 0) + x))").alias(f"{name}_e")


def _side(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} rlike '\\\\s' then 1 when {c} rlike '\\\\p{{L}}' then 2 when {c} rlike '[0-9]' then 3 else 4 end"


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind number, start, end) and proposed (with features): a row for each row of ``docs``, no shuffle."""
    texts = doc_texts(docs)
    found = texts.select("doc_id", *[c for k in KINDS for c in (*_matches(k, BASE[k], QUICK[k], f"b_{k}"), *_matches(k, LOOSE[k], LOOSE_QUICK[k], f"l_{k}"))])
    kept = [c for k in KINDS for c in (f"b_{k}_m", f"l_{k}_m", f"l_{k}_p")]
    placed = found.select("doc_id", *kept, *[_ends(f"{p}_{k}") for k in KINDS for p in ("b", "l")])
    base, proposed = [], []
    for n, k in enumerate(KINDS):
        checked = "true" if k == "email" else _passes(k, "s.m")
        base.append(f"transform(filter(transform(b_{k}_m, (m, i) -> struct(m, b_{k}_e[i] as e)), s -> {checked}), s -> struct({n} as kind, s.e - char_length(s.m) as start, s.e as end))")
        digits = "char_length(regexp_replace(m, '^00|[^0-9]', ''))"
        binned = " + ".join(f"int({digits} >= {d})" for d in DIGITS[1:])
        proposed.append(
            f"transform(l_{k}_m, (m, i) -> struct({n} as kind, l_{k}_e[i] - char_length(m) as start, l_{k}_e[i] as end, {binned} as digits, "
            f"{_side(f'right(l_{k}_p[i], 1)')} as before, {_side(f'left(l_{k}_p[i + 1], 1)')} as after, int({_passes(k, 'm')}) as passes, "
            f"int(lower(right(l_{k}_p[i], 24)) rlike {_quoted(CONTEXT[k])}) as context))"
        )
    return placed.select("doc_id", F.expr(f"concat({', '.join(base)})").alias("base"), F.expr(f"concat({', '.join(proposed)})").alias("proposed"))


def counted(rows: DataFrame) -> list[dict]:
    """Proposals by features: all of them, those that coincide with a base span of their kind (hits), and those that say anything (n:
    hits, and proposals that fail their check). At most 4 * 8 * 5 * 5 * 2 * 2 rows."""
    key = lambda s: f"(cast({s}.start as bigint) * 536870912 + {s}.end) * 4 + {s}.kind"
    held = rows.select("proposed", F.expr(f"transform(base, b -> {key('b')})").alias("keys"))
    fields = ", ".join(f"p.{f} as {f}" for f in FEATURES)
    cells = held.select(F.expr(f"inline(transform(proposed, p -> struct({fields}, int(array_contains(keys, {key('p')})) as hit)))"))
    said = F.when((F.col("hit") == 1) | (F.col("passes") == 0), 1).otherwise(0)
    cells = cells.groupBy(*FEATURES).agg(F.count("*").alias("all"), F.sum(said).alias("n"), F.sum("hit").alias("hits"))
    return sorted((r.asDict() for r in cells.collect()), key=lambda r: [r[f] for f in FEATURES])


def _chance(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _leaf(cells: Sequence[dict]) -> float:
    return SHRINK * sum(c["g"] for c in cells) / (LEAST + sum(c["h"] for c in cells))


def _gain(cells: Sequence[dict]) -> float:
    return sum(c["g"] for c in cells) ** 2 / (LEAST + sum(c["h"] for c in cells))


def _grow(cells: Sequence[dict], depth: int):
    """A leaf's value, or (feature, value, tree where feature < value, tree elsewhere)."""
    best = None
    for f in FEATURES if depth else ():
        for v in sorted({c[f] for c in cells})[1:]:
            low, high = [c for c in cells if c[f] < v], [c for c in cells if c[f] >= v]
            gain = _gain(low) + _gain(high) - _gain(cells)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, v, low, high
    return _leaf(cells) if best is None else (best[1], best[2], _grow(best[3], depth - 1), _grow(best[4], depth - 1))


def _value(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] < tree[1] else tree[3]
    return tree


def boost(cells: list[dict], rounds: int = ROUNDS, depth: int = 3) -> list:
    """Gradient boosting of the logistic loss over counted cells; each cell is given its score."""
    trees = []
    for c in cells:
        c["f"] = 0.0
    for _ in range(rounds if cells else 0):
        for c in cells:
            p = _chance(c["f"])
            c["g"], c["h"] = c["hits"] - c["n"] * p, c["n"] * p * (1 - p)
        trees.append(_grow(cells, depth))
        for c in cells:
            c["f"] += _value(trees[-1], c)
    return trees


def thresholds(cells: list[dict], precision: float = PRECISION) -> list[float]:
    """For each kind the lowest score from which the proposals have the precision; over 1 where none has."""
    out = []
    for kind in range(len(KINDS)):
        hits = n = 0
        best = 2.0
        by_score: dict[float, list[int]] = {}
        for c in cells:
            if c["kind"] == kind:
                both = by_score.setdefault(round(_chance(c["f"]), 6), [0, 0])
                both[0] += c["hits"]
                both[1] += c["n"]
        for score in sorted(by_score, reverse=True):
            hits, n = hits + by_score[score][0], n + by_score[score][1]
            if n and hits >= precision * n:
                best = score
        out.append(best)
    return out


def _sql(tree, of: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"case when {of}.{tree[0]} < {tree[1]} then {_sql(tree[2], of)} else {_sql(tree[3], of)} end"


def pii(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone long (base spans), base_sha256, spans, n_added long, min_score double.

    A row for each row of ``docs``, repeated rows and null ids too; a null text is an empty one, without spans.
    spans holds kind:start:end of base and added spans by kind as listed, then start; positions are code points,
    the end exclusive. Added spans overlap neither base spans nor each other: from left to right, of two that
    overlap the one of the higher score stays, else the earlier. min_score is the least score of an added span
    (null without). A kind without base spans in the table gains none. Ties in score go to the earlier span. Columns
    other than doc_id and text are not looked at; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = materialise(proposals(docs))
    cells = counted(rows)
    trees = boost(cells)
    cut = thresholds(cells)
    total = " + ".join(_sql(t, "p") for t in trees) or "0D"
    score = f"round(1 / (1 + exp(-greatest(-30D, least(30D, {total})))), 6)"
    limit = "case p.kind " + " ".join(f"when {k} then {t!r}D" for k, t in enumerate(cut)) + " end"
    extra = f"filter(transform(proposed, p -> struct(p.start as start, 1 as extra, p.end as end, p.kind as kind, {score} as score, {limit} as cut)), p -> p.score >= p.cut)"
    line = rows.withColumn("line", F.expr(f"array_sort(concat(transform(base, b -> struct(b.start as start, 0 as extra, b.end as end, b.kind as kind, 2D as score, 0D as cut)), {extra}))"))
    span = "struct<start:int,extra:int,end:int,kind:int,score:double,cut:double>"
    closed = "case when a.last is null then a.done else array_append(a.done, a.last) end"
    step = f"""
        case when x.extra = 0 then struct(case when a.last.end > x.start then a.done else {closed} end as done, cast(null as {span}) as last, greatest(a.taken, x.end) as taken)
             when x.start < a.taken or (a.last.end > x.start and a.last.score >= x.score) then a
             when a.last.end > x.start then struct(a.done as done, x as last, a.taken as taken)
             else struct({closed} as done, x as last, a.taken as taken) end"""
    start = f"struct(cast(array() as array<{span}>) as done, cast(null as {span}) as last, 0 as taken)"
    added = line.withColumn("added", F.expr(f"aggregate(line, {start}, (a, x) -> {step}, a -> {closed})"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = lambda spans: f"concat_ws(',', transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)))"
    return added.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, b -> b.kind = {n})) as long)").alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.expr(f"sha2(cast({listed('base')} as binary), 256)").alias("base_sha256"),
        F.expr(listed("concat(base, transform(added, a -> struct(a.kind as kind, a.start as start, a.end as end)))")).alias("spans"),
        F.expr("cast(size(added) as long)").alias("n_added"),
        F.expr("array_min(transform(added, a -> a.score))").alias("min_score"),
    )

