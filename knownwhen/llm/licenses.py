"""Licence scan by digests of canonical texts, in DataFrame and SQL functions.

Texts are brought to a canonical form: letter case, punctuation and spacing are levelled,
copyright lines dropped, equivalent spellings replaced. Digests of the forms are hash-joined to
the digests of known licences: of a document's entire text, and of each run of its lines that
begins like a known form and is as long, however the lines are wrapped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knownwhen.llm.tables import doc_texts, materialise, prepare

#: Usual one-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)
#: Whole licences, in known_licenses: the words at which a known form may begin and before which it may end ("": where the file does).
TEXTS = {
    "Apache-2.0": (("", "TERMS AND CONDITIONS FOR USE"), ("", "APPENDIX: How to apply", "END OF TERMS AND CONDITIONS")),
    "BSD-2-Clause": (("",), ("",)),
    "BSD-3-Clause": (("",), ("",)),
    "CC0-1.0": (("", "CC0 1.0 Universal", "Statement of Purpose"), ("",)),
    "GPL-2.0": (("", "Everyone is permitted to copy", "Preamble"), ("", "How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    "GPL-3.0": (("", "Everyone is permitted to copy", "Preamble"), ("", "How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    "ISC": (("",), ("",)),
    "LGPL-2.1": (("", "Everyone is permitted to copy", "Preamble"), ("", "How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    "LGPL-3.0": (("", "Everyone is permitted to copy", "This version of the GNU Lesser"), ("",)),
    "MIT": (("",), ("",)),
    "MPL-2.0": (("", "1. Definitions"), ("", "Exhibit A - ")),
    "Unlicense": (("",), ("", "For more information")),
}
#: Standard headers as the same files have them.
HEADERS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the", ("",)),
    "GPL-2.0": ("This program is free software; you can redistribute", ("Also add information", "You should have received", "This program is distributed in")),
    "GPL-3.0": ("This program is free software: you can redistribute", ("Also add information", "You should have received", "This program is distributed in")),
    "LGPL-2.1": ("This library is free software; you can redistribute", ("Also add information", "You should have received", "This library is distributed in")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of", ("If it is not possible",)),
}
#: Titles that stand above the text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "ISC": ("ISC License", "The ISC License"),
    "Unlicense": ("The Unlicense",),
}
#: A table of known licences is broadcast up to this many digests.
BROADCAST = 100_000
#: A run is looked at if its first words are those of a known form. Up to so many beginnings are told before rows are made of lines.
ANCHOR, LISTED = 4, 2_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Signs that count as a space, and those that stand for a letter.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\x0b\x0c ‘’“”–—…"
_FROM = _UPPER + _SIGNS + "©"
_TO = _UPPER.lower() + " " * len(_SIGNS) + "c"
#: Equivalent spellings, after levelling; plain text.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("https ", "http "), ("gnu gpl", "gnu general public license"))
#: The same for patterns: v2, v 2 and version 2; 2.0 and 2.
PATTERNS = ((r"(^|[ \n])v ?([0-9])", (1, "version ", 2)), (r"version ([0-9]+) 0($|[ \n])", ("version ", 1, 2)))
COPYRIGHT = r"^(copyright |copyright$|c [12][0-9]{3}( |$)|all rights reserved$)"
#: In runs a line that goes on with a licence's own sentence stays: where lines are wrapped must not matter.
RUN_COPYRIGHT = COPYRIGHT.replace("copyright |copyright$", "copyright (?!(notices?|holders?|owners?|licenses?|laws?|statements?|disclaimers?|interests?|treaty|infringement|permission|rights?|and|or|on|in|is|the|also|to|for)( |$))")

WRAPPED_VERSION = r"(?i)\b(v|ver|version)\.?[ \t]*\n[ \t#*/;-]*(?=[0-9])"


def all_lines(text: Column) -> Column:
    """The lines of the canonical form, empty ones and those about copyright too."""
    out = F.regexp_replace(F.translate(text, _FROM, _TO), " {2,}", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, parts in PATTERNS:
        out = F.regexp_replace(out, pattern, "".join(f"${p}" if isinstance(p, int) else p for p in parts))
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def canonical_lines(text: Column) -> Column:
    """The lines of the canonical form: none of them empty, none about copyright."""
    return F.filter(all_lines(text), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def run_lines(text: Column) -> Column:
    """The same for runs; a line that ends before a version's number goes on with the next."""
    text = F.regexp_replace(F.translate(text, "\r", ""), WRAPPED_VERSION, "$1 ")
    return F.filter(all_lines(text), lambda x: (x != "") & ~x.rlike(RUN_COPYRIGHT))


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " ").cast("binary"), 256)


def forms() -> list[tuple[str, str]]:
    """license_id, text of all that is known: notices, whole licences with and without their titles and ends, headers."""
    out = list(NOTICES)
    for name, (starts, ends) in TEXTS.items():
        text = (Path(__file__).parent / "known_licenses" / f"{name}.txt").read_text()
        cuts = [(text.index(a), text.index(b, text.index(a)) if b else len(text)) for a in starts for b in ends]
        if name in HEADERS:
            a, header_ends = HEADERS[name]
            at = text.index(a)
            cuts += [(at, text.index(b, at) if b else len(text)) for b in header_ends]
        for a, b in cuts:
            # Conditions are numbered, or have bullets.
            for body in {text[a:b], re.sub(r"(?m)^ *[0-9]\. ", "", text[a:b]) if name.startswith("BSD") else text[a:b]}:
                out += [(name, f"{title}\n{body}") for title in ("", *TITLES.get(name, ()))]
    return out


def known(spark: SparkSession, notices: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """A row for each known form, see with_digests()."""
    return with_digests(spark.createDataFrame(forms() if notices is None else list(notices), "license_id string, text string"))


def with_digests(licenses: DataFrame) -> DataFrame:
    """sha, license_id (of several of a form the least), whole, and for runs anchor, n_chars; from a table (license_id, text) of any size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = licenses.select("license_id", F.explode(F.array(F.struct(canonical_lines(text).alias("lines"), F.lit(True).alias("whole")), F.struct(run_lines(text).alias("lines"), F.lit(False).alias("whole")))).alias("x"))
    own = own.select("license_id", "x.whole", F.array_join("x.lines", " ").alias("form")).filter("form <> ''")
    own = own.groupBy("whole", F.sha2(F.col("form").cast("binary"), 256).alias("sha")).agg(
        F.min("license_id").alias("license_id"), F.min(F.substring_index("form", " ", ANCHOR)).alias("anchor"), F.min(F.substring_index("form", " ", -ANCHOR)).alias("tail"), F.min(F.char_length("form")).alias("n_chars"))
    return own


_CHUNK = 512


def _running(sizes: Column) -> Column:
    """Running sums of an array, chunk by chunk, so that long arrays are not copied for each of their members."""
    add = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
    none = F.array().cast("array<int>")
    count = F.ceil(F.size(sizes) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda c: F.aggregate(F.slice(sizes, (c - 1) * _CHUNK + 1, F.lit(_CHUNK)), none, add))
    base = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, xs: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))))
    return F.flatten(F.zip_with(chunks, F.slice(base, 1, F.size(base) - 1), lambda xs, b: F.transform(xs, lambda x: x + b)))


def runs(docs: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """doc_id, license_id, n: runs of lines that are a known form and lie in no longer such run, counted.

    A place where a run may begin meets the known forms with that beginning, and then, by the number of its
    characters, the line at which such a form would end, and its last words. Only what has both ends is cut from
    the text and digested; the rows of places hold numbers, so a text's cost is in proportion to its places and to the
    length of the forms that fit there.
    """
    hint = F.broadcast if small else lambda df: df
    starts = hint(table.select("anchor", "n_chars", "tail").distinct())
    anchors = [r[0] for r in table.select("anchor").distinct().limit(LISTED + 1).collect()]
    short = sorted({len(a.split(" ")) for a in anchors} - {ANCHOR}) if len(anchors) <= LISTED else list(range(1, ANCHOR))
    words = sorted({a.split(" ")[0] for a in anchors})

    def begins(lines: Column) -> Column:
        # Neighbours by place: a slice would copy the whole array at every line.
        heads = F.array(F.transform(lines, lambda x: F.substring_index(x, " ", ANCHOR)))
        first = lambda h, i: F.substring_index(F.concat_ws(" ", *[F.get(h, i + j) for j in range(ANCHOR)]), " ", ANCHOR)
        anchor = lambda h, x, i: F.when(F.substring_index(x, " ", 1).isin(words), first(h, i)) if len(anchors) <= LISTED else first(h, i)
        out = F.transform(heads, lambda h: F.transform(h, lambda x, i: F.struct((i + 1).alias("at"), anchor(h, x, i).alias("anchor"))))[0]
        # Forms of fewer words are told by all of their words.
        return F.filter(out, lambda b: b["anchor"].isin(anchors) if len(anchors) <= LISTED and not short else b["anchor"].isNotNull())

    # An array of one, so that the lines are worked out once for all that look at them.
    own = docs.select("doc_id", F.transform(F.array(run_lines(F.col("text"))), lambda ls: F.struct(ls.alias("lines"), begins(ls).alias("begins")))[0].alias("x"))
    at = own.filter(F.size("x.begins") > 0).select("doc_id", "x.*")
    # Texts with a place where a run may begin, numbered once they are written; a line counts its characters and a space.
    held = materialise(at.select("doc_id", "lines", "begins", F.transform("lines", lambda x: F.char_length(x) + 1).alias("sizes"))).withColumn("row", F.monotonically_increasing_id())
    tail = F.transform("lines", lambda x, i: F.substring_index(F.concat_ws(" ", *[F.when(i >= j, F.get(F.col("lines"), i - j)) for j in reversed(range(ANCHOR))]), " ", -ANCHOR))
    ends = held.select("row", F.posexplode(F.arrays_zip(_running(F.col("sizes")).alias("reached"), tail.alias("tail"))).alias("line", "e"))
    ends = materialise(ends.select("row", (F.col("line") + 1).alias("line"), "e.reached", "e.tail"))
    places = held.select("row", F.explode("begins").alias("b")).select("row", "b.at", F.explode(F.array_distinct(F.array(F.col("b.anchor"), *[F.substring_index("b.anchor", " ", n) for n in short]))).alias("anchor"))
    places = places.join(starts, "anchor").select("row", "at", "n_chars", F.col("tail").alias("form_tail")).distinct()
    # What is reached before a place: the end of the line before it.
    before = ends.select("row", (F.col("line") + 1).alias("at"), F.col("reached").alias("passed"))
    places = places.join(before, ["row", "at"], "left").select("row", "at", "form_tail", (F.coalesce("passed", F.lit(0)) + F.col("n_chars") + 1).alias("reached"))
    same_tail = F.expr("substring_index(tail, ' ', -size(split(form_tail, ' '))) = form_tail")
    spans = places.join(ends, ["row", "reached"]).filter(same_tail).groupBy("row").agg(F.collect_set(F.struct("at", F.col("line").alias("last"))).alias("spans"))
    cut = spans.join(held.select("row", "doc_id", "lines"), "row")
    cut = cut.select("row", "doc_id", F.explode(F.transform("spans", lambda s: F.struct(s["at"].alias("at"), (s["last"] + 1).alias("end"), digest(F.slice(F.col("lines"), s["at"], s["last"] - s["at"] + 1)).alias("sha")))).alias("s"))
    found = cut.select("row", "doc_id", "s.*").join(hint(table.select("sha", "license_id")), "sha")
    inside = Window.partitionBy("row").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.max("end").over(inside)).filter("before is null or before < end").select("doc_id", "license_id", F.lit(1).alias("n"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """Returns doc_id, canonical_sha256, license_id (entire text; null: unknown), n_notices long, notices (ids, sorted, comma-joined).

    A row for each row of ``docs``. A null text is an empty one; texts without canonical lines have no licence.
    n_notices counts the runs of whole lines that are a known form, notices their distinct ids; a run within a
    longer one does not count again. Rows of one doc_id
    (null is one too) share their notices, counted over all of them. A text's cost grows with its length, however
    often a known form begins in it. Columns other than doc_id and text are not looked at; an empty table gives an
    empty result.
    """
    spark = prepare(docs.sparkSession)
    table = materialise(with_digests(licenses) if licenses is not None else known(spark))
    small = table.count() <= BROADCAST
    texts = doc_texts(docs)
    notices = runs(texts, table.filter("not whole"), small).groupBy("doc_id").agg(F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    notices = notices.withColumnRenamed("doc_id", "of")
    hint = F.broadcast if small else lambda df: df
    entire = table.filter("whole").select("sha", "license_id")
    # An entire text whose wrapping meets the copyright lines or a version is known by its form as a run.
    as_run = table.filter("not whole").select(F.col("sha").alias("run_sha"), F.col("license_id").alias("run_id"))
    run_sha = F.when(F.col("text").rlike(r"(?i)copyright|\bv(er|ersion)?\.?[ \t]*\r?\n"), digest(run_lines(F.col("text"))))
    whole = texts.select("doc_id", digest(canonical_lines(F.col("text"))).alias("sha"), run_sha.alias("run_sha"))
    whole = whole.withColumn("run_sha", F.coalesce("run_sha", "sha"))
    whole = whole.join(hint(entire), "sha", "left").join(hint(as_run), "run_sha", "left")
    out = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", F.col("sha").alias("canonical_sha256"), F.coalesce("license_id", "run_id").alias("license_id"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_lines(text: str) -> str:
    signs = "".join(c for c in _FROM if c not in "\t\r\x0b\x0c")
    to = "".join(t for c, t in zip(_FROM, _TO, strict=True) if c not in "\t\r\x0b\x0c")
    blanks = " || ".join(f"chr({ord(c)})" for c in "\t\r\x0b\x0c")
    out = f"regexp_replace(translate({text}, {_text(signs)} || {blanks}, {_text(to + '    ')}), ' {{2,}}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_text(old)}, {_text(new)})"
    for pattern, parts in PATTERNS:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(''.join(chr(92) + str(p) if isinstance(p, int) else p for p in parts))}, 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, {_text(COPYRIGHT)}))"


SQL = f"""
with licenses(license_id, text) as (values {", ".join(f"({_text(i)}, {_text(t)})" for i, t in NOTICES)}),
known as (select sha256(array_to_string(lines, ' ')) as sha, min(license_id) as license_id
          from (select license_id, {_duck_lines("text")} as lines from licenses) group by 1),
forms as (select doc_id, {_duck_lines("coalesce(text, '')")} as lines from documents),
notices as (select doc_id, count(*) as n, string_agg(distinct license_id, ',' order by license_id) as ids
            from (select doc_id, sha256(line) as sha from (select doc_id, unnest(lines) as line from forms)) join known using (sha) group by 1)
select f.doc_id, f.sha as canonical_sha256, k.license_id, cast(coalesce(n.n, 0) as bigint) as n_notices, coalesce(n.ids, '') as notices
from (select doc_id, sha256(array_to_string(lines, ' ')) as sha from forms) f
left join known k using (sha) left join notices n on n.doc_id is not distinct from f.doc_id
"""
