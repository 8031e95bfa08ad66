"""Ordered scans and time joins that split hot keys.

A plain window puts a whole key into one task. These helpers cut every key into
time segments first: the scan runs inside a segment, segment totals (one row per
key and segment) are scanned on their own, and the two meet in an equi-join. A key
that holds a third of the table is therefore spread over as many tasks as it has
segments. Series with at most one row per key and session need none of this.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import c
from knownwhen.session import small


def _fold(kind: str, x: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product, "count": F.count}[kind](x)


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
    if kind == "product":
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before * inside)
    if kind == "max":
        return F.greatest(before, inside)
    if kind == "min":
        return F.least(before, inside)
    return F.coalesce(inside, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    cols: Mapping[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Add running values per key. ``cols`` maps a name to (kind, column).

    Kinds: sum, count, max, min, product, last (last non-null). ``order`` must be
    total within a key and ``segment`` must rise with it. The input is read twice, the
    second time for few columns; a caller that chains scans materialises in between.
    """
    sort = [F.col(o).desc_nulls_last() if reverse else F.col(o).asc_nulls_first() for o in order]
    stop = -1 if exclusive else 0
    src = df.withColumn("_seg", segment)
    for name, (_, x) in cols.items():
        src = src.withColumn(f"_in_{name}", x)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*sort).rowsBetween(Window.unboundedPreceding, stop)
    seg_sort = F.col("_seg").desc() if reverse else F.col("_seg").asc()
    before = Window.partitionBy(*keys).orderBy(seg_sort).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*[F.col(o) for o in order])

    totals, rows = [], src
    for name, (kind, _) in cols.items():
        x = F.col(f"_in_{name}")
        if kind == "last":
            seen = F.when(x.isNotNull(), rank)
            totals.append((F.min_by if reverse else F.max_by)(x, seen).alias(f"_t_{name}"))
            rows = rows.withColumn(f"_w_{name}", F.last(x, ignorenulls=True).over(inside))
        else:
            totals.append(_fold(kind, x).alias(f"_t_{name}"))
            rows = rows.withColumn(f"_w_{name}", _fold(kind, x).over(inside))
    seg = src.groupBy(*keys, "_seg").agg(*totals)
    for name, (kind, _) in cols.items():
        t = F.col(f"_t_{name}")
        carried = F.last(t, ignorenulls=True) if kind == "last" else _fold("sum" if kind == "count" else kind, t)
        seg = seg.withColumn(f"_b_{name}", carried.over(before))
    seg = seg.select(*keys, "_seg", *[f"_b_{n}" for n in cols])
    out = rows.join(seg, [*keys, "_seg"], "left")
    for name, (kind, _) in cols.items():
        out = out.withColumn(name, _combine(kind, F.col(f"_b_{name}"), F.col(f"_w_{name}")))
    return out.select(*[x for x in df.columns if x not in cols], *cols)


def month_of(x: Column | str) -> Column:
    return F.trunc(c(x).cast("date"), "month")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_cols: Sequence[str],
    *,
    tie: Sequence[str] = (),
    strict: bool = False,
    forward: bool = False,
    segment=month_of,
) -> DataFrame:
    """Each left row with the newest right row at or before it (``strict``: before it).

    ``forward`` takes the oldest right row at or after instead. ``tie`` orders right
    rows that share an instant. Left rows without a match keep nulls.
    """
    payload = F.struct(F.col(right_time).alias("_rt"), *[F.col(x) for x in right_cols])
    ties = [F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)]
    # At one instant a right row sorts before the left row it may match, or after if strict.
    right_side = (1 if strict else -1) * (-1 if forward else 1)
    r = right.select(*keys, F.col(right_time).alias("_at"), F.lit(right_side).alias("_side"), *ties, payload.alias("_hit"))
    lcols = left.columns
    lft = left.select(*keys, F.col(left_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*lcols).alias("_row"))
    both = lft.unionByName(r, allowMissingColumns=True)
    order = ["_at", "_side", *[f"_tie{i}" for i in range(len(ties))]]
    out = running(both, keys, order, segment("_at"), {"_m": ("last", F.col("_hit"))}, reverse=forward)
    out = out.where(F.col("_row").isNotNull())
    clash = [x for x in right_cols if x in lcols]
    assert not clash, f"rename right columns first: {clash}"
    return out.select("_row.*", *[F.col("_m")[x].alias(x) for x in right_cols])


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    point: str,
    *,
    unit: str = "day",
    closed: bool = False,
) -> DataFrame:
    """Rows of ``intervals`` with every point in ``[start, end)`` (``closed``: ``[start, end]``).

    Both sides meet on an equi-key of calendar buckets, so no nested loop is planned.
    An open end is a null; it is clipped at the last point. Without further keys the points
    are a side table of instants: counted, and broadcast only if small, so that intervals
    stay where they are.
    """
    if not keys:
        points = small(points)
    first, last = points.agg(F.min(point)).scalar(), points.agg(F.max(point)).scalar()
    lo, hi = F.greatest(F.col(start), first), F.least(F.coalesce(F.col(end), last), last)
    step = F.expr(f"interval 1 {unit}")
    buckets = F.sequence(F.trunc(lo.cast("date"), unit) if unit != "day" else lo.cast("date"), hi.cast("date"), step)
    cut = intervals.where(lo <= hi).withColumn("_bucket", F.explode(buckets))
    at = F.col(point).cast("date")
    pts = points.withColumn("_bucket", F.trunc(at, unit) if unit != "day" else at)
    after = F.col(point) >= F.col(start)
    until = F.col(end).isNull() | ((F.col(point) <= F.col(end)) if closed else (F.col(point) < F.col(end)))
    return cut.join(pts, [*keys, "_bucket"]).where(after & until).drop("_bucket")
