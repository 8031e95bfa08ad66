"""The pipeline's stages: columns, decisions against brute force, odd tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from knownwhen.llm import mixing
from tests.llm.test_operators import linked, rows

SF = "/root/testdata/sf0.001"
BY_NAME = dict(P.STAGES)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"] and P.ORACLE_SQL is None


def test_copies_and_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = rows(docs.select("doc_id", "text"))
    largest = {}
    for i, t in pairs:
        largest[t] = max(i, largest.get(t, i))
    out = BY_NAME["exact_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r[0] for r in rows(out.select("doc_id"))) == sorted(largest.values())
    near = BY_NAME["near_dedup"](spark, docs, SF)
    assert sorted(r[0] for r in rows(near.select("doc_id"))) == [r[0] for r in linked(pairs, 5) if r[3]]


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path, odd_labels):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    all_ids = Counter(r[0] for r in rows(odd_docs.select("doc_id")))
    for name, stage in P.STAGES:
        out = stage(spark, odd_docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == odd_docs.columns, name
        assert Counter(r[0] for r in rows(out.select("doc_id"))) <= all_ids
        assert rows(stage(spark, no_docs, str(tmp_path))) == []


def test_run_keeps_rows_of_documents(spark):
    ids = [r[0] for r in rows(P.run(spark, SF).select("doc_id"))]
    assert 50 < len(ids) == len(set(ids)) < 200


def test_rare_cells_do_not_shrink_the_mix(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise(F.repeat(F.lit("word "), 200)).alias("text"),
                                    F.when(F.col("id") == 1, "en").otherwise(F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("id") % 3 + 1).cast("int"))).alias("lang"),
                                    F.when(F.col("id") == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"))
    kept = {r[0]: r[1] for r in rows(BY_NAME["mixing"](spark, docs, SF).groupBy("source").count())}
    assert kept[None] == 1
    assert abs(sum(kept.values()) / 4000 - mixing.BUDGET) < 0.03
    assert kept["hot"] > 0.6 * 4000 / 3


def test_budget_is_met_with_full_cells(spark):
    cells = spark.createDataFrame([("a", "x", "p", 900), ("a", "y", "p", 50), ("b", "x", "p", 40), ("b", "y", "q", 9), ("c", "y", "q", 1)], "source string, lang string, topic string, tokens long")
    got = rows(mixing.rake_within(cells, mixing.tempered(cells), 0.8).select("source", "tokens", "weight"))
    assert all(0 < w <= n for _, n, w in got) and abs(sum(w for *_, w in got) - 800) < 1
    assert dict((s, w) for s, _, w in got)["c"] > 0.99
