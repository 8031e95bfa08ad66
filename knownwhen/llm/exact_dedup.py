"""Exact deduplication by Grace hashing.

Records are partitioned by the leading bits of a content hash; a partition whose distinct
contents would not fit the table is partitioned again by further bits, until all fit. The
shuffle files are the spill files, so a lost executor costs no more than its own part. Each
bucket then goes through an open-addressing table that compares complete contents.

Every task first runs its own records through such a table, so a content is shuffled once per
task, not once per copy; a content that very many tasks hold meets in salted buckets before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import doc_texts, materialise, prepare

#: Bytes of distinct content that one bucket may hold in memory; further hash bits split what is larger.
BUCKET_BYTES = 16 << 20
#: At most so many contents are salted (their hashes are broadcast): those with more than this share of all rows.
SALTED_CONTENTS = 100_000
#: Fewer copies than this are never salted.
SALT_FROM = 64
SALTS = 32

_RECORD = "bucket long, hash long, text binary, keep_id long, copies long"
_GROUP = "hash long, text_sha256 string, keep_id long, group_size long"


class OpenTable:
    """Linear probing over a power-of-two array of slots; equal means equal in every byte."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.largest: list[int | None] = []
        self.copies: list[int] = []
        self.bytes = 0

    def _slot(self, hashed: int, text: bytes | None) -> int:
        mask = len(self.slots) - 1
        # The leading bits are the same throughout a bucket.
        at = (hashed ^ (hashed >> 29)) & mask
        while (entry := self.slots[at]) >= 0 and (text is None or self.hashes[entry] != hashed or self.texts[entry] != text):
            at = (at + 1) & mask
        return at

    def add(self, hashed: int, text: bytes, doc_id: int | None, copies: int) -> None:
        at = self._slot(hashed, text)
        entry = self.slots[at]
        if entry >= 0:
            self.copies[entry] += copies
            if doc_id is not None and (self.largest[entry] is None or doc_id > self.largest[entry]):
                self.largest[entry] = doc_id
            return
        self.slots[at] = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        self.largest.append(doc_id)
        self.copies.append(copies)
        self.bytes += len(text)
        if 3 * len(self.texts) > 2 * len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for entry, h in enumerate(self.hashes):
                self.slots[self._slot(h, None)] = entry


def _records(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("bucket", "hash", "text", "keep_id", "copies")), strict=True)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each content and task; when the table is full it is passed on and begun anew."""
    table, bucket_of = OpenTable(), {}

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(table.texts), 500):
            part = slice(i, i + 500)
            hashes = table.hashes[part]
            columns = [[bucket_of[h] for h in hashes], hashes, table.texts[part], table.largest[part], table.copies[part]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "hash", "text", "keep_id", "copies"])
        table.clear()
        bucket_of.clear()

    for bucket, hashed, text, doc_id, copies in _records(batches):
        bucket_of[hashed] = bucket
        table.add(hashed, text, doc_id, copies)
        if table.bytes > BUCKET_BYTES:
            yield from out()
    yield from out()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records come bucket by bucket; one row for each content."""
    table, current = OpenTable(), None

    def out() -> Iterator[pa.RecordBatch]:
        digests = [hashlib.sha256(t).hexdigest() for t in table.texts]
        columns = [pa.array(table.hashes, pa.int64()), pa.array(digests, pa.string()), pa.array(table.largest, pa.int64()), pa.array(table.copies, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["hash", "text_sha256", "keep_id", "group_size"])
        table.clear()

    for bucket, hashed, text, doc_id, copies in _records(batches):
        if bucket != current and current is not None:
            yield from out()
        current = bucket
        table.add(hashed, text, doc_id, copies)
    yield from out()


def _prefix(bits: int):
    return F.shiftrightunsigned(F.col("hash"), 64 - bits)


def buckets(contents: DataFrame, first_bits: int, bucket_bytes: int = BUCKET_BYTES) -> list[tuple[int, DataFrame]]:
    """Recursive partitioning: for each further level the prefixes that are still too large, and their bits.

    ``contents``: hash, bytes. A prefix with a single content is not split; the table holds it alone.
    """
    levels, bits, left = [], first_bits, contents
    while bits <= 56:
        sizes = left.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("contents"))
        big = sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("contents") > 1)).select("prefix")
        big = materialise(big)
        if big.isEmpty():
            break
        levels.append((bits, big))
        left = left.withColumn("prefix", _prefix(bits)).join(big, "prefix", "left_semi").drop("prefix")
        bits += 4
    return levels


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """hash, text_sha256, keep_id, group_size: a row for each distinct text."""
    texts = doc_texts(docs)
    keyed = texts.select(F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    contents = materialise(keyed.groupBy("hash").agg(F.max(F.octet_length("text")).cast("long").alias("bytes"), F.sum("copies").alias("copies")))
    total = contents.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first_bits = max(4, (max(8 * parts, total[0] * 2 // bucket_bytes) - 1).bit_length())
    bucket = _prefix(first_bits)
    for bits, big in buckets(contents, first_bits, bucket_bytes):
        # Few or none; Spark broadcasts them below its own bound on bytes and shuffles beyond it.
        mark = big.select(F.col("prefix").alias("too_big"))
        keyed = keyed.join(mark, _prefix(bits) == F.col("too_big"), "left")
        bucket = F.when(F.col("too_big").isNotNull(), _prefix(bits + 4) + F.lit(bits + 4) * F.lit(1 << 57)).otherwise(bucket)
        keyed = keyed.withColumn("bucket", bucket).drop("too_big")
        bucket = F.col("bucket")
    keyed = keyed.withColumn("bucket", bucket)
    # Every such content has more than 1 / SALTED_CONTENTS of the rows, so there are no more than SALTED_CONTENTS.
    heavy = materialise(contents.filter(F.col("copies") > max(SALT_FROM, total[1] // SALTED_CONTENTS)).select("hash"))
    fields = ["bucket", "hash", "text", "keep_id", "copies"]
    if heavy.isEmpty():
        records = keyed.select(*fields).mapInArrow(_combine, _RECORD)
    else:
        light = keyed.join(F.broadcast(heavy), "hash", "left_anti").select(*fields).mapInArrow(_combine, _RECORD)
        hot = keyed.join(F.broadcast(heavy), "hash", "left_semi").select(*fields).mapInArrow(_combine, _RECORD)
        hot = hot.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("hash", "salt").select(*fields).mapInArrow(_combine, _RECORD)
        records = light.unionByName(hot)
    return records.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, _GROUP)


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Returns doc_id, keep_id, group_size long, kept boolean, text_sha256: a row for each row of ``docs``.

    Texts are equal when every byte is; a null text is an empty one, and empty texts form one group.
    keep_id is the largest doc_id of the group (null only if all are), kept: doc_id = keep_id, where
    null equals null. Rows that repeat doc_id and text count and are marked alike. Columns other than
    doc_id and text are not looked at. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    groups = exact_groups(docs, bucket_bytes)
    # The group's own row is found by 64 + 256 bits of its content; a popular group is split by adaptive execution.
    rows = doc_texts(docs).select("doc_id", F.xxhash64("text").alias("hash"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(groups, ["hash", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
