"""Lloyd rounds against a plain loop."""

import hashlib
import math

import numpy as np
import pytest

from knownwhen.llm import centroids


def naive(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), label in zip(kept, labels, strict=True) if label == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    each = [sum(d for _, label, d in last if label == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, label, d, each[label], sum(each), sha[label]) for i, label, d in last]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, block string")


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1])] + [(1000 + i, rows[0][1]) for i in range(50)]
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, []), (404, [None] * 64), (405, [float("nan")] + [0.0] * 63), (406, [0.0] * 63 + [float("-inf")])]
    rows += [(500 + i, [x * 40 for x in rows[i][1]]) for i in range(4)]
    same(centroids.cluster(table(spark, rows)).collect(), naive(rows))
    same(centroids.cluster(table(spark, rows), task_rows=20, columns=24).collect(), naive(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)] + [(90, None)]
    same(centroids.cluster(table(spark, rows)).collect(), naive(rows))


def test_empty_clusters_keep_their_centroid(spark):
    rows = [(i, [1.5] * 64) for i in range(20)] + [(None, [-2.0] * 64)]
    same(centroids.cluster(table(spark, rows)).collect(), naive(rows))


def test_blocks_are_not_shuffled_again(spark):
    """Labels are dealt to the blocks' own partitions: grouping both keeps their number and order."""
    sc = spark.sparkContext
    centroids.shared_folder(spark)

    def home(key):
        return key % 3

    a = sc.parallelize([(i, i) for i in range(9)]).partitionBy(3, home)
    a.checkpoint()
    a.count()
    both = a.mapValues(lambda x: x).union(sc.parallelize([(i, -i) for i in range(9)]).partitionBy(3, home))
    assert both.getNumPartitions() == 3 and both.groupByKey(3, home).getNumPartitions() == 3
    assert both.groupByKey(3, home).toDebugString().decode().count("ShuffledRDD") == 1


def test_too_large_is_an_error(spark):
    with pytest.raises(ValueError):
        centroids.cluster(table(spark, [(1, [1e12] * 64)]))
