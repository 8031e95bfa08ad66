"""From raw documents to token ids: each stage works on the rows that the one before it kept.

The stages but the last return the columns of documents. Between stages the rows are written as
Parquet and read again, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownwhen.llm import bpe, mixing, near_dedup, toxicity
from knownwhen.llm import exact_dedup as exact
from knownwhen.llm.tables import Rounds, keep_rows, table, unused


def _same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold; null and empty texts have the score of a text without words."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, threshold = unused(docs, "score", "threshold")
    rows = toxicity.scored(docs, model, score, threshold)
    return _same_columns(rows.filter(F.col(score) < F.col(threshold)), docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text the one with the largest id; of rows that repeat it, one. A null text is an empty one; a
    row without an id is the largest of none but its like. Other columns ride along; an empty table stays empty."""
    kept = exact.exact_dedup(docs).filter("kept").select("doc_id")
    return keep_rows(docs, kept, single=True)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 per cent of their five-word shingles the one with the smallest id. Null,
    empty and blank texts and rows without an id stay; rows that repeat the kept id stay too. An empty table stays empty."""
    kept = near_dedup.near_dedup(docs, width=5, percent=80).filter("kept").select("doc_id")
    return keep_rows(docs, kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities, so that a stated share of all tokens has its target weights of sources, languages and topics as far as they have the tokens.

    Null sources and languages are a value of their own, null and empty texts have no tokens and stay; rows that
    repeat an id share its draw. An empty table stays empty.
    """
    rows, names = mixing.drawn(docs, budget=mixing.BUDGET)
    return _same_columns(rows.filter(F.col(names["kept"])), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document. A null text is an empty one, without tokens; rows
    that repeat stay, as does one without an id; an empty table gives an empty result."""
    return bpe.encode(docs, tokens=True).drop("decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classifier and the encoder are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Rounds(spark)
    for _, stage in STAGES[:-1]:
        # A stage's table is deleted once the next one's is written.
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
