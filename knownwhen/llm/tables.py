"""What the operators share: reading a table, an id column that may be null, cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownwhen.session import configure, materialise, shared_folder, written

#: Rows and bytes of an Arrow batch: a batch of long texts stays small, whatever a session sets elsewhere.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text only (null text counts as empty), so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame, single: bool = False) -> DataFrame:
    """The rows of ``docs`` (all columns) whose doc_id, null included, stands in ``kept``.

    ``single``: of rows that repeat both doc_id and text, one.
    """
    none, value = unused(docs, "no_id", "id_value")
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), value: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    right = kept.select(F.col("doc_id").isNull().alias(none), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(value)).distinct()
    out = keyed.join(right, [none, value], "left_semi")
    if single:
        out = out.dropDuplicates([none, value, "text"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


class Rounds:
    """Tables written one after the other in the shared folder, each from the one before, which is deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        out = self.spark.read.schema(df.schema).parquet(self.path)
        if before:
            sc = self.spark.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        return out


__all__ = ["Rounds", "doc_texts", "held_out", "keep_rows", "materialise", "prepare", "table", "unused", "written"]
