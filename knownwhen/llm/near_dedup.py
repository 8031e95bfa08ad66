"""Near-duplicate documents by HyperMinHash: banded registers propose, estimates sift, full sets confirm.

Documents of equal shingle sets are one representative from the start. Representatives that share a
band stand in one bucket. In each bucket the member that shares most buckets with others is the
hub; all others are compared with it, which joins a group of any size by as many pairs as it has
members. Only where a bucket still holds several components are all pairs across them compared,
in blocks of bounded size inside tasks, so that no row is made for a pair. Each pair is looked at
in the first band that it shares. Small sets, whose registers are too few to be sure of a common
band, also stand in the buckets of their rarest shingles, as many as two linked sets cannot all
differ in. Links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownwhen.llm import hyperminhash as H
from knownwhen.llm import words
from knownwhen.llm.tables import Rounds, doc_texts, materialise, prepare

#: An estimate this far below the threshold rules a pair out: five standard deviations of 128 registers.
MARGIN = 0.18
#: Sets up to this size are compared without an estimate, and found by their rarest shingles too.
SMALL = 64
#: Bytes of full sets in one block of a bucket; larger buckets are compared block by block.
BLOCK_BYTES = 4 << 20


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, d1, d2 (128 bits of a digest of the set), regs (registers, four to a long), small (the set, if it is small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, regs, small = [], [], [], [], []
            for texts in words.pieces(batch.column("text")):
                sets = H.shingle_sets(texts, width)
                digest = np.frombuffer(b"".join(hashlib.sha256(s.tobytes()).digest()[:16] for s in sets), "<i8").reshape(-1, 2)
                n += map(len, sets)
                small += [s.view("<i8") if 0 < len(s) <= SMALL else None for s in sets]
                d1.append(digest[:, 0])
                d2.append(digest[:, 1])
                regs.append(H.bands(H.registers(sets)))
            flat = np.concatenate(regs).ravel() if regs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * H.BANDS), pa.array(flat))
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), join(d1), join(d2), lists, pa.array(small, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "regs", "small"])

    texts = doc_texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, regs array<long>, small array<long>")


#: Up to so many ids are broadcast to pick their texts; beyond it the texts are shuffled.
PICKED = 500_000


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text (bytes) of the named documents, one row for each id and text."""
    ids = ids.select(F.col("id").alias("doc_id")).distinct()
    if ids.count() <= PICKED:
        ids = F.broadcast(ids)
    texts = doc_texts(docs).join(ids, "doc_id", "left_semi")
    return texts.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    least, most = min(len(a), len(b)), max(len(a), len(b))
    if not least or 100 * least < percent * most:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(width: int, percent: int):
    """Of rows id, hub, text, hub_text those that are links, as a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, theirs = None, None
        for batch in batches:
            a, b = [], []
            for i, h, text, hub_text in zip(*(batch.column(c).to_pylist() for c in ("id", "hub", "text", "hub_text")), strict=True):
                if hub != (h, hub_text):
                    hub, theirs = (h, hub_text), H.shingle_sets([hub_text], width)
                mine = H.shingle_sets([text], width)
                near = H.estimate(*H.registers(mine + theirs)) >= percent / 100 - MARGIN
                if (near or max(len(mine[0]), len(theirs[0])) <= SMALL) and similar(mine[0], theirs[0], percent):
                    a.append(min(i, h))
                    b.append(max(i, h))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def pairs(comp: np.ndarray, part: np.ndarray, size: np.ndarray, regs: np.ndarray, band: int, across: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a group and the later ones that each must be compared with, by position.

    A pair counts if its components differ, no earlier band is shared, sizes allow the similarity and the
    estimate does not rule it out. ``across``: only pairs of different parts, the others meet elsewhere.
    ``comp`` may change while pairs are drawn.
    """
    registers = regs.view(np.uint16)
    for i in range(len(comp) - 1):
        rest = np.arange(i + 1, len(comp))
        fits = (comp[rest] != comp[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        if across:
            fits &= part[rest] != part[i]
        rest = rest[fits]
        if len(rest):
            rest = rest[(regs[rest, :band] != regs[i, :band]).all(axis=1)]
        if len(rest):
            near = H.estimate(registers[rest], registers[i]) >= percent / 100 - MARGIN
            rest = rest[near | (np.maximum(size[rest], size[i]) <= SMALL)]
        if len(rest):
            yield i, rest


GROUP = ("band", "key", "left", "right")


def _grouped(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[list]]]:
    """Rows come group by group; a group's key and its columns, if it has several rows."""
    held, current = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*GROUP, *columns)), strict=True):
            if row[:4] != current:
                if len(held) > 1:
                    yield current, list(zip(*held, strict=True))
                held, current = [], row[:4]
            held.append(row[4:])
    if len(held) > 1:
        yield current, list(zip(*held, strict=True))


def _sift(percent: int):
    """The members of each group that some pair still needs, judged by registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, key, left, right), (ids, comp, part, size, regs) in _grouped(batches, "id", "comp", "part", "n", "regs"):
            needed: set[int] = set()
            for i, rest in pairs(np.array(comp), np.array(part), np.array(size), np.array(regs, np.int64), band, left != right, percent):
                needed.add(i)
                needed.update(rest.tolist())
            on = sorted(needed)
            pick = lambda values, on=on: [values[i] for i in on]
            columns = [pa.array([v] * len(on), k) for v, k in ((band, pa.int32()), (key, pa.int64()), (left, pa.int32()), (right, pa.int32()))]
            columns += [pa.array(pick(ids), pa.int64()), pa.array(pick(comp), pa.int64()), pa.array(pick(part), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*GROUP, "id", "comp", "part"])

    return run


def _across(width: int, percent: int):
    """The links of each group across components, as a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, left, right), (ids, comps, part, texts) in _grouped(batches, "id", "comp", "part", "text"):
            sets = H.shingle_sets(list(texts), width)
            comp, found = np.array(comps), []
            for i, rest in pairs(comp, np.array(part), np.array([len(s) for s in sets]), H.bands(H.registers(sets)), band, left != right, percent):
                for j in rest:
                    if comp[i] != comp[j] and similar(sets[i], sets[j], percent):
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        comp[comp == comp[j]] = comp[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) of every id in ``links`` (a, b).

    Each round an id takes the smallest label among its neighbours, then its label's own label; the rounds
    end when no label falls any more.
    """
    both = materialise(links.union(links.select("b", "a")).toDF("id", "other").distinct())
    tables = Rounds(links.sparkSession)
    labels = tables.write(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("comp").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "theirs").alias("step"))
        jumped = hooked.join(labels.select(F.col("id").alias("step"), F.col("comp").alias("beyond")), "step")
        after = tables.write(jumped.select("id", "was", F.least("step", "beyond").alias("comp")))
        if after.filter(F.col("comp") < F.col("was")).isEmpty():
            return after.select("id", "comp")
        labels = after.select("id", "comp")


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """id, shingle: of each set (id, n, small) so many of its rarest shingles that linked sets share one of them.

    A set linked with one of n shingles lacks n - ceil(n * percent / 100) of them at most. Shingles are ordered by
    how many sets hold them, then by value; those of one set alone lead nowhere and are left out.
    """
    each = sets.filter("small is not null").select("id", "n", F.explode("small").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    order = Window.partitionBy("id").orderBy(F.coalesce("sets", F.lit(1)), "shingle")
    first = F.row_number().over(order) <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return each.join(held, "shingle", "left").withColumn("first", first).filter("first and sets > 1").select("id", "n", "shingle")


def near_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, representatives (d1, d2, n, rep), and rep, component where a representative is linked."""
    signed = materialise(_signatures(docs, width))
    alike = ["d1", "d2", "n"]
    reps = materialise(signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*alike).agg(F.min("doc_id").alias("rep")))
    # One row for each representative, with its registers.
    one = signed.withColumnRenamed("doc_id", "rep").join(reps, [*alike, "rep"]).select(F.col("rep").alias("id"), "n", "regs", "small")
    banded = one.select("id", "n", F.posexplode("regs").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "id", "n", "band")
    # Beyond the bands: a pair that shares one of them has been looked at there.
    rare = rarest(one, percent).select(F.xxhash64(F.lit("rare"), "shingle").alias("key"), "id", "n", F.lit(H.BANDS).alias("band"))
    banded = banded.unionByName(rare)
    counts = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialise(banded.join(counts, "key"))
    popular = shared.groupBy("id").agg(F.sum("members").alias("popular"))
    hubs = shared.select("key", "id").join(popular, "id").groupBy("key").agg(F.max_by(F.col("id"), F.struct("popular", -F.col("id"))).alias("hub"))
    edges = materialise(shared.select("key", "id").join(hubs, "key").filter("id <> hub").select("id", "hub").distinct())
    hub_texts = _texts(docs, edges.select(F.col("hub").alias("id"))).select(F.col("id").alias("hub"), F.col("text").alias("hub_text"))
    compared = edges.join(_texts(docs, edges), "id").join(hub_texts, "hub").select("id", "hub", "text", "hub_text")
    links = materialise(compared.mapInArrow(_confirm(width, percent), "a long, b long"))
    comps = components(links)
    placed = materialise(shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("total")).filter("low < high").select("key", "total")
    blocks = F.ceil(F.col("total") * 8 / BLOCK_BYTES).cast("int")
    left = placed.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")}).select(*GROUP, "id", "comp", "part", "n")
    met = left.join(one.select("id", "regs"), "id").repartition(*GROUP).sortWithinPartitions(*GROUP, "id")
    needed = materialise(met.mapInArrow(_sift(percent), "band int, key long, left int, right int, id long, comp long, part int"))
    dealt = needed.join(_texts(docs, needed), "id").repartition(*GROUP).sortWithinPartitions(*GROUP, "id")
    more = materialise(dealt.mapInArrow(_across(width, percent), "a long, b long"))
    if not more.isEmpty():
        comps = components(links.union(more))
    return signed, reps, comps.select(F.col("id").alias("rep"), "comp")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Returns doc_id, n_shingles, component_id long, kept boolean: a row for each row of ``docs``.

    A set holds the distinct shingles of ``width`` words of the whole text; with fewer words, the one of all
    words; null, empty and blank texts have none and are linked with nothing. Documents are linked from
    ``percent`` per cent of shared shingles on; component_id is the smallest doc_id reachable, kept:
    doc_id = component_id. Rows that repeat an id with different texts are linked by each text; rows without
    an id stay apart (component_id null, kept). Columns other than doc_id and text are not looked at; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    signed, reps, comps = near_components(docs, width, percent)
    # Popular sets are split by adaptive execution.
    found = signed.select("doc_id", "d1", "d2", "n").join(reps, ["d1", "d2", "n"], "left").join(comps, "rep", "left")
    comp: Column = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
