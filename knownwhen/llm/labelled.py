"""Labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import held_out

#: Only labelled texts up to this many bytes are learnt from; all texts are scored whole.
LONGEST = 20_000


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of the documents that may be learnt from: none held out. A label that is null is no label; of several of a document the largest counts."""
    out = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    out = out.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    return out.groupBy("doc_id").agg(F.max("label").alias("label"))


def learnable(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Every row whose document may be learnt from, with its label: give it what is learnt from, not texts, as rows move to their labels."""
    return rows.join(known(labels, label), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label, text, lang of at most ``most`` rows of each class; never a held-out row.

    The labels are cut to the sample before the join, so that side is bounded and broadcast. A label that is
    null is no label; of several labels of a document the largest counts.
    """
    order = F.xxhash64("doc_id")
    picked = [known(labels, label).filter(F.col("label") == k).orderBy(order, "doc_id").limit(most) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most rows of two numbers
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), lang.cast("string").alias("lang"))
    texts = texts.filter(F.octet_length("text") <= LONGEST)
    # Repeated rows of a document do not enlarge the sample.
    return texts.join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)


__all__ = ["LONGEST", "known", "learnable", "sample"]
