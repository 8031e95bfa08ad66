"""Exact top-k search by block-at-a-time pruning.

Vectors of a range of ids form a block: a forward index (their integer vectors) with the largest
and least value of every term. For a query, a block cannot score above the sum over terms of the
query's value times the block's extreme on that side. Blocks are taken in falling order of this
bound, scored through the forward index, and left as soon as the bound is below the kth score.

Each block belongs to one shard and is moved once. Only the queries are copied, to every shard; a
task holds a shard's blocks and lets the queries stream past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownwhen.llm.tables import materialise, prepare

#: Rows of a block, rows of a shard (what a task holds), queries scored together.
BLOCK_ROWS = 512
SHARD_ROWS = 1 << 16
CHUNK_QUERIES = 256
SCALE = 1024.0
#: Integers up to 2**53 are exact in double precision.
EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return own.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is zero."""
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``a`` with ``b``: in doubles where every partial sum fits, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if most < 2.0**62 else (a.astype(object) @ b.astype(object)).astype(np.int64)


def search(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vec_id, score) of each query's best among the blocks, and how many blocks were scored."""
    out, scored = [], 0
    high = np.stack([m.max(axis=0) for _, m in blocks]).astype(np.float64)
    low = np.stack([m.min(axis=0) for _, m in blocks]).astype(np.float64)
    q = queries.astype(np.float64)
    # A bound in doubles may be off by a rounding; one part in 2**40 more makes up for it.
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    slack = (np.maximum(q, 0) @ np.abs(high).T - np.minimum(q, 0) @ np.abs(low).T) * 2.0**-40 + 1e-6
    bounds += slack
    for i, own in enumerate(query_ids.tolist()):
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if len(best_score) == k and bounds[i, b] < best_score[-1]:
                break
            ids, rows = blocks[b]
            scores, others = _dot(rows, queries[i]), ids != own
            scored += 1
            best_score, best_id = np.concatenate([best_score, scores[others]]), np.concatenate([best_id, ids[others]])
            order = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[order], best_id[order]
        out += [(own, int(x), int(s)) for x, s in zip(best_id, best_score, strict=True)]
    return out, scored


_BLOCK = "shard int, kind int, at long, ids array<long>, v array<long>, sizes array<int>"


def blocks(held: DataFrame, shards: int) -> DataFrame:
    """shard, kind 0, at, ids, v (components one after the other), sizes: blocks of BLOCK_ROWS rows that follow each other by id.

    Rows are ranked by range, with their place in the table to part rows of one id, so that neither sparse ids nor
    an id of many rows changes a block's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                ids, v = part.column("vec_id").to_pylist(), part.column("v")
                columns = [[(at * 0x9E3779B97F4A7C15 >> 32) % shards], [0], [at], [ids], [v.flatten().to_pylist()], [v.value_lengths().to_pylist()]]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "kind", "at", "ids", "v", "sizes"])
                at += 1

    placed = held.withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(shards, "vec_id", "place").sortWithinPartitions("vec_id", "place").select("vec_id", "v").mapInArrow(run, _BLOCK)


def _searched(width: int, k: int):
    """Shard by shard: the blocks are held, then each chunk of queries is searched in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forward, ids, asked = None, [], [], []

        def found() -> pa.RecordBatch:
            out = search(np.array(ids, np.int64), _matrix(asked, width), forward, k)[0] if forward and ids else []
            ids.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            lists, sizes = batch.column("v"), batch.column("sizes")
            for i, (own, kind, members) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                if own != shard:
                    yield found()
                    shard, forward = own, []
                values = lists[i].values.to_numpy(zero_copy_only=False)
                if kind == 0:
                    rows = np.zeros((len(members), width), np.int64)
                    rows[np.arange(width) < sizes[i].values.to_numpy()[:, None]] = values
                    forward.append((np.array(members, np.int64), rows))
                else:
                    ids.append(members[0])
                    asked.append(values.tolist())
                    if len(ids) >= CHUNK_QUERIES:
                        yield found()
        yield found()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = SCALE) -> DataFrame:
    """Returns query_id long, rank int (from 1), vec_id long, score long: each query's k best, ties to smaller ids.

    Vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part; a
    shorter vector counts zeros for what it lacks. Candidates of a query are all rows of another id. Of rows
    that repeat a query's id the least vector asks, once; repeated candidates each count. Components are
    taken as 64-bit integers, as is the score; a score beyond that is an error. Other columns are not looked at; an empty table, or one without
    queries, gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    held = materialise(integer_vectors(vectors, scale))
    asked = held.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, math.ceil(rows / SHARD_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(rows / BLOCK_ROWS)))
    forward = materialise(blocks(held, shards))
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("vec_id").alias("at"), F.array("vec_id").alias("ids"), "v", F.array(F.size("v")).alias("sizes"))
    # A shard's blocks come first, then the queries.
    met = forward.unionByName(copies).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "at")
    near = met.mapInArrow(_searched(width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over best as integer) as rank, vec_id, score from s
window best as (partition by query_id order by score desc, vec_id) qualify row_number() over best <= 10
"""
