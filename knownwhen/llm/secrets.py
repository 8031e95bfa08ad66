"""Secrets by linking the parts of a credential, in DataFrame and SQL functions.

Strict patterns give base spans, which always stay. Weak patterns name further parts: access
identifiers, secrets and endpoints. A weak part alone is nothing; it is reported when a part that
complements it (an identifier or endpoint for a secret, a secret for an identifier) stands near it in
the same scope, a stretch of text without a blank line. Parts and the stretch of text that each
reaches are dealt to cells of REACH code points; weak parts meet what reaches their cells in a left
semi join on (text, cell) with the interval condition. A cell holds as many parts as fit into it,
so no key grows with its text. Texts are linked once however often they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownwhen.llm.tables import doc_texts, materialise, prepare

KINDS = ("assign", "access", "hex")
#: Code points between two parts of one credential, at most.
REACH = 256
ACCESS, SECRET, ENDPOINT = range(3)
_TO = r"[\x22']?+\x20*+[:=]\x20*+[\x22']?+"
#: The contract's patterns in possessive form, the same matches without backtracking; the counts that drop no other match stand in the pattern.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _TO + r"([A-Za-z0-9+/_.=-]++)"
#: (name, what a text must hold, pattern, kind, role, weak)
PATTERNS = (
    ("assign", r"[:=]", ASSIGN, 0, SECRET, 0),
    ("access", r"AKIA", r"AKIA[A-Z0-9]{14,}+", 1, ACCESS, 0),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16}", r"(?<![0-9a-f])[0-9a-f]{16,}+", 2, SECRET, 0),
    ("weak_assign", r"[:=]", r"(?<![A-Za-z])(?i:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:(?:private|access|auth|api)[_-]?)?(?:token|key)|credentials?)[\x22']?+\x20*+(?:=>|:=|[:=])\x20*+[\x22']?+[^\s\x22'<>,;=]{4,256}+", 0, SECRET, 1),
    ("weak_access", r"[:=]|A[A-Z]{2}A[A-Z0-9]{8}", r"(?<![A-Za-z])(?i:access[_-]?key[_-]?id|(?:client|account|key)[_-]?id|user(?:[_-]?(?:name|id))?|login)" + _TO + r"[A-Za-z0-9._@+-]{3,128}+|(?<![A-Z0-9])A(?:KI|SI|GP|ID|RO)A[A-Z0-9]{8,64}+", 1, ACCESS, 1),
    ("weak_hex", r"[0-9][A-Za-z]|[A-Za-z][0-9]", r"(?<![0-9A-Za-z+/])(?=[A-Za-z+/]{0,255}[0-9])(?:(?=[0-9]{0,255}[A-Fa-f])[0-9A-Fa-f]{12,256}+(?![0-9A-Za-z+/])|(?=[a-z0-9+/]{0,255}[A-Z])(?=[A-Z0-9+/]{0,255}[a-z])[A-Za-z0-9+/]{20,256}+(?![0-9A-Za-z+/]))", 2, SECRET, 1),
    ("endpoint", r"[:=]", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s\x22'<>]{3,256}+|(?<![A-Za-z])(?i:host(?:name)?|endpoint|server|database|bucket|url)" + _TO + r"[A-Za-z0-9._:/-]{3,256}+", -1, ENDPOINT, 2),
)
_CHUNK = 128
_SUM = "struct<n:bigint,b:bigint>"


def _quoted(pattern: str) -> str:
    assert '"' not in pattern
    return f'r"{pattern}"'


def _found(name: str, quick: str, pattern: str) -> list[Column]:
    """The matches of a pattern and the pieces of text around them."""
    some = f"text rlike {_quoted(quick)}"
    return [
        F.expr(f"case when {some} then regexp_extract_all(text, {_quoted(pattern)}, 0) else array() end").alias(f"{name}_m"),
        F.expr(f"case when {some} then split(text, {_quoted(pattern)}, -1) else array() end").alias(f"{name}_p"),
    ]


def _chunks(name: str) -> Column:
    """Running sums of code points and blank lines up to the end of each match, begun anew in each chunk of matches."""
    steps = f"transform({name}_m, (m, i) -> named_struct('n', cast(char_length({name}_p[i]) + char_length(m) as bigint), 'b', cast(size(split({name}_p[i], r'\\n[ \\t\\r]*+\\n', -1)) - 1 as bigint)))"
    last = "coalesce(try_element_at(acc, -1).{0}, 0L) + x.{0}"
    inner = f"aggregate(slice({steps}, c * {_CHUNK} + 1, {_CHUNK}), cast(array() as array<{_SUM}>), (acc, x) -> array_append(acc, named_struct('n', {last.format('n')}, 'b', {last.format('b')})))"
    return F.expr(f"case when size({name}_m) = 0 then cast(array() as array<array<{_SUM}>>) else transform(sequence(0, (size({name}_m) - 1) div {_CHUNK}), c -> {inner}) end").alias(f"{name}_c")


def _ends(name: str) -> Column:
    """Where each match ends, and the blank lines before it."""
    add = "element_at(acc, -1).{0} + element_at(xs, -1).{0}"
    bases = f"aggregate({name}_c, cast(array(named_struct('n', 0L, 'b', 0L)) as array<{_SUM}>), (acc, xs) -> array_append(acc, named_struct('n', {add.format('n')}, 'b', {add.format('b')})))"
    return F.expr(f"flatten(zip_with({name}_c, slice({bases}, 1, size({name}_c)), (xs, b) -> transform(xs, x -> named_struct('n', x.n + b.n, 'b', x.b + b.b))))").alias(f"{name}_e")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end), parts (role, kind, weak, start, end, scope) and a text's digest where it has weak parts: a row for each row of ``docs``."""
    texts = doc_texts(docs)
    names = [p[0] for p in PATTERNS]
    found = texts.select("doc_id", "text", *[c for name, quick, pattern, *_ in PATTERNS for c in _found(name, quick, pattern)])
    summed = found.select("doc_id", "text", *[f"{n}_m" for n in names], *[_chunks(n) for n in names])
    ended = summed.select("doc_id", "text", *[f"{n}_m" for n in names], *[_ends(n) for n in names])
    listed = []
    for name, _, _, kind, role, weak in PATTERNS:
        own = f"transform({name}_m, (m, i) -> named_struct('role', {role}, 'kind', {kind}, 'weak', {weak}, 'start', {name}_e[i].n - char_length(m), 'end', {name}_e[i].n, 'scope', {name}_e[i].b, 'm', m))"
        if name == "assign":
            own = f"filter({own}, s -> char_length(regexp_extract(s.m, {_quoted(ASSIGN)}, 1)) >= 12)"
        listed.append(f"transform({own}, s -> named_struct('role', s.role, 'kind', s.kind, 'weak', s.weak, 'start', s.start, 'end', s.end, 'scope', s.scope))")
    rows = ended.select("doc_id", "text", F.expr(f"concat({', '.join(listed)})").alias("parts"))
    weak = F.exists("parts", lambda p: p["weak"] == 1)
    base = F.expr("transform(filter(parts, p -> p.weak = 0), p -> named_struct('start', p.start, 'kind', p.kind, 'end', p.end))")
    return rows.select("doc_id", base.alias("base"), F.when(weak, F.col("parts")).alias("parts"), F.when(weak, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """digest, added (start, kind, end): the weak parts of each text that a complementary part stands near."""
    texts = rows.filter("digest is not null").groupBy("digest").agg(F.first("parts").alias("parts"))
    each = materialise(texts.select("digest", F.inline("parts")))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / reach), F.floor(high / reach))).alias("cell")
    # A base span that holds a weak part says it all.
    before = Window.partitionBy("digest").orderBy("start", "weak", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weak = each.withColumn("covered", F.max(F.when(F.col("weak") == 0, F.col("end"))).over(before)).filter((F.col("weak") == 1) & (F.coalesce(F.col("covered"), F.lit(0)) < F.col("end")))
    weak = weak.select("digest", "role", "kind", "start", "end", "scope", cells(F.col("start"), F.col("end"))).alias("w")
    near = each.select("digest", "role", "start", "end", "scope", cells(F.col("start") - reach, F.col("end") + reach)).alias("p")
    c = F.col
    left = c("p.end").between(c("w.start") - reach, c("w.start"))
    right = c("p.start").between(c("w.end"), c("w.end") + reach)
    complement = F.when(c("w.role") == SECRET, c("p.role") != SECRET).otherwise(c("p.role") == SECRET)
    on = (c("w.digest") == c("p.digest")) & (c("w.cell") == c("p.cell")) & (c("w.scope") == c("p.scope")) & complement & (left | right)
    kept = weak.join(near, on, "left_semi").select("digest", "kind", "start", "end").distinct()
    # Parts that overlap are one span, of the kind that begins first.
    order = Window.partitionBy("digest").orderBy("start", "kind", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = kept.withColumn("new", F.when(reached > F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy("digest", "island").agg(F.min("start").alias("start"), F.min_by("kind", F.struct("start", "kind")).alias("kind"), F.max("end").alias("end"))
    return spans.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex long (base spans), base_sha256, spans string, n_added long.

    A row for each row of ``docs``, repeated rows and null ids too; a null text is an empty one, without spans.
    spans holds kind:start:end of base and added spans by start, then kind as listed; positions are code points,
    the end exclusive. Added spans are weak parts within ``reach`` code points of a complementary part in the same
    scope; those that overlap are one span, and none lies within a base span. Equal texts have equal spans. Columns
    other than doc_id and text are not looked at; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = materialise(parts(docs))
    own = rows.select("doc_id", "base", "digest")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    plain = own.filter("digest is null").select("doc_id", "base", none.alias("added"))
    more = own.filter("digest is not null").join(linked(rows, reach), "digest", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = lambda spans: f"concat_ws(',', transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)))"
    return plain.unionByName(more).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, b -> b.kind = {n})) as long)").alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.expr(f"sha2(cast({listed('base')} as binary), 256)").alias("base_sha256"),
        F.expr(listed("concat(base, added)")).alias("spans"),
        F.expr("cast(size(added) as long)").alias("n_added"),
    )
