"""Centroid clustering by dimension-sharded Lloyd rounds over integer vectors.

Vectors are cut twice: into blocks of rows and into slices of columns (shards). A task of a shard
holds blocks of its own columns alone and is given its own slice of the centroids. It works out the
exact partial distances of its blocks; ``reduceByKey`` adds the shards of a block and takes the
least. The labels go back to the shards, each of which sums its own columns by cluster and moves its
own slice. The blocks stay where they are in all rounds: labels are dealt by the partitioner that
the blocks have, so that no vector is shuffled again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownwhen.llm.tables import materialise, prepare, written
from knownwhen.session import shared_folder

#: Columns of a shard, rows of a task.
SHARD_COLUMNS = 16
TASK_ROWS = 1 << 16
SCALE = 1024.0
#: Numbers of a centroid table at most: it goes to every task, slice by slice.
CENTROID_NUMBERS = 1 << 22
#: Block numbers count batches within a task of the writing stage.
_BATCHES = 1 << 32


def integer_vectors(vectors: DataFrame, width: int, scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter((F.size("embedding") == width) & whole)
    return own.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The smallest integers that hold the numbers."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _sliced(width: int, columns: int):
    """Arrow batches of vectors to one record for each shard; the ids go with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * _BATCHES
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            parts = [_packed(x[:, at : at + columns]) for at in range(0, width, columns)]
            n = len(parts)
            ids = pa.array([batch.column("vec_id").to_pylist()] + [None] * (n - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([len(x)] * n, pa.int64()), ids, pa.array([k for k, _ in parts]), pa.array([b for _, b in parts], pa.binary())],
                names=["block", "shard", "n", "ids", "kind", "data"],
            )
            block += 1

    return run


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids in 64-bit integers."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = x - centroid
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def _sums(x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and row counts by cluster."""
    out = np.zeros((k, x.shape[1]), np.int64)
    for c in range(k):
        out[c] = x[labels == c].sum(axis=0, dtype=np.int64)
    return out, np.bincount(labels, minlength=k).astype(np.int64)


def _nearest(d: np.ndarray) -> np.ndarray:
    return d.argmin(axis=1).astype(np.int32)


def _check_range(most: int, rows: int, width: int) -> None:
    if width * 4 * most * most >= 1 << 63 or most * rows >= 1 << 63:
        raise ValueError("distances or sums of these components exceed 64 bits")


def _of_cluster(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)


def seeds(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the k least hashes of ``salt:vec_id``; rows without an id come last, ties go to the least vector."""
    text = F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string"))
    first = kept.withColumn("h", F.sha2(text.cast("binary"), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r.v for r in first.select("v").collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, salt: str = "3", scale: float = SCALE, columns: int = SHARD_COLUMNS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Returns vec_id long, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 string: a row for each vector kept.

    Vectors of another width, null ones, and those that hold null, NaN or infinite components take no part. Rows
    that repeat an id are vectors of their own; a null id is kept, and begins a cluster only where ids are too few.
    Fewer vectors than ``k`` make as many clusters as there are vectors. Ties in distance go to the smaller cluster;
    an empty cluster keeps its centroid. Distances beyond 64 bits are an error. Other columns are not looked at; an
    empty table gives an empty result. ``salt``, ``scale``: the hash of the first centroids and the integer scale.
    """
    spark = prepare(vectors.sparkSession)
    shared_folder(spark)
    kept = integer_vectors(vectors, width, scale)
    centroids = seeds(kept, k, salt)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    if centroids.size > CENTROID_NUMBERS:
        raise ValueError(f"{centroids.size} numbers of centroids exceed {CENTROID_NUMBERS}")
    k = len(centroids)
    held = written(kept.mapInArrow(_sliced(width, columns), "block long, shard int, n long, ids array<long>, kind string, data binary"))
    most = kept.agg(F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    _check_range(int(most[0]), int(most[1]), width)

    shards = math.ceil(width / columns)
    slices = max(math.ceil(most[1] / task_rows), math.ceil(spark.sparkContext.defaultParallelism / shards))

    def slice_of(block: int) -> int:
        return (block * 0x9E3779B97F4A7C15 >> 32) % slices

    def home(key: tuple[int, int]) -> int:
        """A partition holds blocks of one shard."""
        return key[0] * slices + slice_of(key[1])

    def matrix(r) -> np.ndarray:
        return np.frombuffer(bytes(r.data), r.kind).reshape(r.n, -1)

    blocks = held.select("block", "shard", "n", "kind", "data").rdd.map(lambda r: ((r.shard, r.block), matrix(r))).partitionBy(shards * slices, home)
    # Once dealt, the blocks are kept in the shared folder: a lost executor reads them there.
    blocks.checkpoint()

    def distances(centroids: np.ndarray):
        """(block, distances to all centroids): the shards' parts added up."""
        mine = [centroids[:, at : at + columns] for at in range(0, width, columns)]
        parts = blocks.map(lambda b: (b[0][1], _distances(b[1].astype(np.int64), mine[b[0][0]])))
        return parts.reduceByKey(np.add, slices, slice_of)

    for _ in range(rounds):
        labels = distances(centroids).mapValues(_nearest)
        dealt = labels.flatMap(lambda b: [((s, b[0]), b[1]) for s in range(shards)]).partitionBy(shards * slices, home)
        # Both are dealt by ``home``, so the union is by partition and grouping moves nothing.
        both = blocks.mapValues(lambda x: (0, x)).union(dealt.mapValues(lambda x: (1, x))).groupByKey(shards * slices, home)
        sums = both.map(lambda b: (b[0][0], _sums(*(v for _, v in sorted(b[1], key=lambda v: v[0])), k)))
        moved = sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards)
        # One slice of k rows for each shard: as many numbers as the centroids have.
        new = moved.mapValues(lambda s: (np.where(s[1][:, None] > 0, s[0] // np.maximum(s[1], 1)[:, None], 0), s[1])).collectAsMap()
        now = np.concatenate([new[s][0] for s in range(shards)], axis=1)
        centroids = np.where(new[0][1][:, None] > 0, now, centroids)

    last = distances(centroids).map(lambda b: (b[0], _nearest(b[1]).tolist(), b[1].min(axis=1).tolist()))
    found = materialise(spark.createDataFrame(last, "block long, cluster array<int>, distance array<long>"))
    ids = held.filter("shard = 0").select("block", "ids")
    rows = found.join(ids, "block").select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    total = found.select(F.inline(F.arrays_zip("cluster", "distance"))).groupBy("cluster").agg(F.sum("distance")).collect()
    inertia = dict(map(tuple, total))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        _of_cluster([inertia.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        _of_cluster(digests).alias("centroid_sha256"),
    )


def _sql(k: int = 8, rounds: int = 10, width: int = 64, salt: str = "3", scale: int = 1024) -> str:
    steps = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = {width} and list_count(embedding) = {width} and len(list_filter(embedding, lambda x: not isfinite(x))) = 0)""",
        f"x as materialized (select r, unnest(range({width})) as d, unnest(v) as x from kept)",
        f"""c0 as materialized (select c, unnest(range({width})) as d, unnest(v) as x from (select v, row_number() over (order by sha256('{salt}:' || cast(vec_id as varchar)) nulls last, v) - 1 as c from kept qualify c < {k}))""",
    ]
    nearest = "(select r, c, cast(sum((x.x - m.x) * (x.x - m.x)) as bigint) as distance from x join {} m using (d) group by r, c qualify row_number() over (partition by r order by cast(sum((x.x - m.x) * (x.x - m.x)) as bigint), c) = 1)"
    for i in range(rounds):
        steps.append(f"a{i} as materialized {nearest.format(f'c{i}')}")
        steps.append(f"s{i} as (select c, d, sum(x) as s, count(*) as n from a{i} join x using (r) group by c, d)")
        steps.append(f"c{i + 1} as materialized (select o.c, o.d, case when n is null then o.x else cast((s - ((s % n) + n) % n) // n as bigint) end as x from c{i} o left join s{i} using (c, d))")
    steps.append(f"last as materialized {nearest.format(f'c{rounds}')}")
    steps.append(f"digests as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c{rounds} group by c)")
    return f"""with {", ".join(steps)}
select vec_id, cast(c as integer) as cluster, distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, centroid_sha256 from last join kept using (r) join digests using (c)"""


SQL = _sql()
