"""Walk-forward schedules, parameter grids, falsifiers, pooled verdicts and trial registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import ratio, reasons, text_array
from knownwhen.operators.metrics import block_bootstrap
from knownwhen.operators.pit import PROMOTION_BARRED
from knownwhen.operators.scan import interval_join, running
from knownwhen.session import written


def walk_forward_splits(ranges: DataFrame, *, window_years: int = 3, step_months: int = 12, purge: int = 21, embargo: int = 5) -> DataFrame:
    """Rolling design and evaluation windows of each keyed range (``start``, ``end``).

    Each design start is one step after the previous one, so a day clamped at a month end
    stays clamped; the starts are folded inside the row, without recursion or joins.
    """
    n = F.ceil(F.months_between("end", "start") / step_months).cast("int") + 1
    starts = F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(F.col("start")),
        lambda acc, i: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), step_months))),
    )
    keep = [x for x in ranges.columns if x not in ("start", "end")]
    x = ranges.select(*keep, F.col("end").alias("_end"), F.posexplode(starts).alias("split_no", "design_start"))
    x = x.withColumn("design_end", F.add_months("design_start", window_years * 12))
    x = x.withColumn("eval_start", F.date_add("design_end", purge + embargo + 1)).where(F.col("eval_start") <= F.col("_end"))
    x = x.withColumn("eval_end", F.least(F.date_sub(F.add_months("eval_start", step_months), 1), F.col("_end")))
    # Only the first split that reaches the end of the range is kept.
    done = Window.partitionBy(*keep).orderBy("split_no").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("eval_end") >= F.col("_end")).over(done), F.lit(False))
    x = x.withColumn("_ended", ended).where("not _ended")
    name = F.concat(F.lit("walk_forward/"), F.col("eval_start").cast("string"), F.lit("_"), F.col("eval_end").cast("string"))
    return x.withColumn("split_id", name).withColumn("kind", F.lit("WALK_FORWARD")).drop("_end", "_ended")


def split_plan(splits: DataFrame, segments: DataFrame, holdout_start: Column, holdout_end: Column) -> DataFrame:
    """All windows to evaluate, each marked if it overlaps the sealed holdout."""
    cols = [x for x in segments.columns]
    both = segments.unionByName(splits.select(*cols))
    return both.withColumn("overlaps_holdout", (F.col("eval_start") <= holdout_end) & (F.col("eval_end") >= holdout_start))


def assign_split(sessions: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each session with the evaluation windows it falls in."""
    return interval_join(splits, sessions, list(keys), "eval_start", "eval_end", "session", unit="month", closed=True)


def independent_blocks(assigned: DataFrame, keys: Sequence[str], block: int = 21) -> DataFrame:
    return assigned.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / block).alias("blocks"))


def sensitivity_grid(dims: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every combination of the declared parameter values, numbered in declared order.

    ``dims`` lists (dimension, value); values become one array per dimension and are
    exploded in turn, so no cross join is planned.
    """
    arrays = dims.groupBy(*keys).agg(
        *[F.array_sort(F.array_compact(F.collect_set(F.when(F.col("dimension") == d, F.col("value"))))).alias(f"_{d}") for d in order]
    )
    out = arrays
    for d in order:
        out = out.select("*", F.posexplode(f"_{d}").alias(f"_i_{d}", d))
    no = F.lit(0)
    for d in order:
        no = no * F.size(f"_{d}") + F.col(f"_i_{d}")
    return out.withColumn("point", no + 1)


def grid_points(grid: DataFrame, order: Sequence[str], registered: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    hit = F.lit(True)
    for d in order:
        hit = hit & (F.col(d) == registered[d])
    return grid.select(*keys, "point", *order, hit.alias("registered"))


def grid_neighbours(grid: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Points that differ in exactly one dimension, generated from the value arrays.

    A neighbour's number follows from the position that changes: output-sized work, no
    self join.
    """
    parts = []
    for i, d in enumerate(order):
        stride = F.lit(1)
        for later in order[i + 1 :]:
            stride = stride * F.size(f"_{later}")
        step = F.transform(f"_{d}", lambda v, j: F.struct(j.alias("j"), v.alias("v")))
        other = F.filter(step, lambda s: s["j"] != F.col(f"_i_{d}"))
        rows = F.transform(
            other,
            lambda s: F.struct(
                F.lit(d).alias("dimension"), s["v"].alias("value"), (F.col("point") + (s["j"] - F.col(f"_i_{d}")) * stride).alias("neighbour")
            ),
        )
        parts.append(rows)
    return grid.select(*keys, "point", F.explode(F.concat(*parts)).alias("n")).select(*keys, "point", "n.*")


def cost_delay_tiers(
    strategies: DataFrame, cost_delays: Mapping[str, int], multipliers: Sequence[float], delays: Sequence[int], missing: Sequence[float]
) -> DataFrame:
    """The cost, delay and missing-data tiers every strategy is run under, as an exploded array.

    Zero delay and dropped data bar promotion evidence.
    """
    base = cost_delays["base"]

    def tier(name, kind, cost, mult, delay, rate, bars):
        return F.struct(
            F.lit(name).alias("tier"), F.lit(kind).alias("kind"), F.lit(cost).alias("cost_tier"), F.lit(float(mult)).alias("multiplier"),
            F.lit(delay).alias("delay_bars"), F.lit(float(rate)).alias("missing_rate"), F.lit(bars).alias("bars_promotion"),
        )

    rows = [tier(f"cost/{n}", "COST", n, 1, d, 0, d == 0) for n, d in cost_delays.items()]
    rows += [tier(f"cost/base_x{m:g}", "COST", "base", m, base, 0, False) for m in multipliers if m != 1]
    rows += [tier(f"delay/{d}", "DELAY", "base", 1, d, 0, d == 0) for d in delays if d != base]
    rows += [tier(f"missing/{r:g}", "MISSING_DATA", "base", 1, base, r, True) for r in missing if r != 0]
    return strategies.select("*", F.explode(F.array(*rows)).alias("_t")).select(*strategies.columns, "_t.*")


def missing_data_injection(rows: DataFrame, rate: float, cols: Sequence[str]) -> DataFrame:
    """Blank features on a fixed share of rows by a running count per trial.

    The count is cut by decision, so a trial is not one task.
    """
    out = running(rows, ["trial"], ["decision", "entity_id"], F.col("decision"), {"_n": ("count", F.lit(1))})
    drop = (F.col("_n") % 100) < rate * 100
    for x in cols:
        out = out.withColumn(x, F.when(~drop, F.col(x)))
    return out.withColumn("injected", drop).drop("_n")


def _sign(x: Column) -> Column:
    return F.signum(x.cast("double"))


def falsifiers(
    m: DataFrame, *, threshold: float, drawdown_ratio: float, min_agreement: float, min_decisions: int
) -> DataFrame:
    """Predicates F1 to F6 per trial, the decision minimum, and the decisive rejection.

    The last is null where the second comparator was not measured: absence is not failure. Any
    other number that is missing is: the trial is UNEVALUATED and does not pass.
    """
    numbers = ("estimate", "lower", "upper", "strategy_drawdown", "benchmark_drawdown", "adverse", "delayed", "without_best", "decisions")
    missing = F.array_contains(F.array(*[F.col(n).isNull() for n in numbers]), True)
    est = F.col("estimate")
    excludes = ((F.col("lower") > 0) & (F.col("upper") > 0)) | ((F.col("lower") < 0) & (F.col("upper") < 0))
    f1 = (est < threshold) | ~excludes
    out = m.withColumn("agreement", F.coalesce(ratio(F.col("agreeing").cast("double"), F.col("grid_size").cast("double")), F.lit(0.0)))
    failed = reasons(
        (f1, "F1"),
        (F.abs("strategy_drawdown") > F.abs("benchmark_drawdown") * drawdown_ratio, "F2"),
        ((_sign(F.col("adverse")) != _sign(est)) | (_sign(F.col("delayed")) != _sign(est)), "F3"),
        (_sign(F.col("without_best")) != _sign(est), "F4"),
        (F.col("agreement") < min_agreement, "F5"),
        (F.col("decisions") < min_decisions, "MINIMUM_DECISIONS"),
        (missing, "UNEVALUATED"),
    )
    beats = (est >= threshold) & ~f1
    decisive = F.when(F.col("secondary").isNotNull(), ~beats & ~(F.col("secondary") > 0))
    return out.withColumn("failed", failed).withColumn("passes", F.size("failed") == 0).withColumn("decisive_rejection", decisive)


def sign_agreement(estimates: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Grid estimates that share the registered point's sign, per trial."""
    j = estimates.join(registered.select(key, "estimate"), key)
    agree = _sign(F.col("grid_estimate")) == _sign(F.col("estimate"))
    return j.groupBy(key).agg(F.count_if(agree).alias("agreeing"), F.count(F.lit(1)).alias("grid_size"))


def pool_splits(rows: DataFrame, planned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each pooled split with what is wrong with it, and planned ones that are missing.

    A session scored by two splits is an error of both.
    """
    per = rows.groupBy(*keys, "session").agg(F.count_distinct("split_id").alias("_n"))
    marked = rows.join(per.where("_n > 1"), [*keys, "session"], "left")
    s = marked.groupBy(*keys, "split_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("_n").alias("n_twice"), F.max("kind").alias("kind"), F.min("session").alias("first"),
    )
    p = planned.select(*keys, "split_id", F.lit(True).alias("planned"))
    out = s.join(p, [*keys, "split_id"], "full_outer")
    errors = reasons(
        (F.col("n").isNull(), "MISSING"),
        (F.col("kind") != "WALK_FORWARD", "WRONG_KIND"),
        (F.col("planned").isNull(), "NOT_PLANNED"),
        (F.col("n_twice") > 0, "SCORED_TWICE"),
    )
    return out.withColumn("errors", errors).drop("planned", "kind")


def chain_link_levels(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rescale each split's levels to continue where the previous split ended."""
    g = levels.groupBy(*keys, "split_id").agg(
        F.min_by("level", "session").alias("_first"), F.max_by("level", "session").alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("split_id").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_carry", F.coalesce(F.product(F.col("_last") / F.col("_first")).over(before), F.lit(1.0)))
    scale = F.when(F.col("_first") > 0, F.col("_carry") / F.col("_first"))
    g = g.select(*keys, "split_id", scale.alias("_scale"))
    return levels.join(g, [*keys, "split_id"]).withColumn("chained", F.col("level") * F.col("_scale")).drop("_scale")


def link_returns(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.product(1 + F.col(value)) - 1).alias("linked"))


def pooled_primary(pairs: DataFrame, gaps: DataFrame, *, threshold: float, resamples: int, keys=("entity_id",)) -> DataFrame:
    """Sharpe difference on the pooled pairs, withheld where it cannot be relied on.

    A gapped split withholds either way; a clear pass is withheld too, because the trial
    adjustment is not applied and can only take a pass away. What remains is a failure.
    """
    boot = block_bootstrap(pairs, ["strategy", "benchmark"], "sharpe", resamples=resamples, keys=keys)

    def sharpe_of(x: str) -> Column:
        sd = F.stddev_samp(x)
        return F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0)

    est = pairs.groupBy(*keys).agg((sharpe_of("strategy") - sharpe_of("benchmark")).alias("estimate"), F.count(F.lit(1)).alias("n"))
    out = est.join(boot, list(keys)).join(gaps, list(keys), "left")
    clears = (F.col("estimate") >= threshold) & F.col("excludes_zero")
    why = reasons((F.coalesce("gapped", F.lit(0)) > 0, "GAPPED_SPLIT"), (clears, "UNADJUSTED_PASS"))
    return out.withColumn("withheld", why).withColumn("passes", F.when(F.size("withheld") == 0, F.lit(False)))


def pooled_secondary(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linked excess over the second comparator; unmeasured if any split lacks it or is gapped."""
    out = splits.groupBy(*keys).agg(
        (F.product(1 + F.col("candidate")) - F.product(1 + F.coalesce("comparator", F.lit(0.0)))).alias("_x"),
        F.count_if(F.col("comparator").isNull()).alias("lacking"),
        F.count_if(F.col("gaps") > 0).alias("gapped"),
    )
    ok = (F.col("lacking") == 0) & (F.col("gapped") == 0)
    return out.withColumn("excess", F.when(ok, F.col("_x"))).withColumn("beats", F.col("excess") > 0).drop("_x")


def pooled_drawdown(curves: DataFrame, gaps: DataFrame, limit: float, keys: Sequence[str]) -> DataFrame:
    """Drawdown of the linked candidate curve against a share of the benchmark's."""
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    x = curves
    for c in ("candidate", "primary"):
        x = x.withColumn(f"_{c}", ratio(F.col(c), F.max(c).over(w)) - 1)
    out = x.groupBy(*keys).agg(F.min("_candidate").alias("candidate_drawdown"), F.min("_primary").alias("primary_drawdown"))
    out = out.join(gaps, list(keys), "left")
    ok = F.coalesce("gapped", F.lit(0)) == 0
    clears = F.abs("candidate_drawdown") <= F.abs("primary_drawdown") * limit
    return out.withColumn("clears", F.when(ok, clears))


def verdict(rows: DataFrame) -> DataFrame:
    """Verdict and promotion in three-valued logic over complete, passes, beats and clears.

    SQL's own null rules do the work: either prong true is review, both false is rejection,
    anything unknown in between is unmeasured.
    """
    either = F.col("passes") | F.col("beats")
    v = (
        F.when(~F.col("complete"), "UNMEASURED")
        .when(either, "OWNER_REVIEW")
        .when(~either, "REJECT")
        .otherwise("UNMEASURED")
    )
    met = F.when(F.col("complete"), F.col("passes") & F.col("clears"))
    mixed = F.coalesce(F.col("complete") & ~F.col("passes") & F.col("beats"), F.lit(False))
    return rows.withColumn("verdict", v).withColumn("promotion_met", met).withColumn("mixed_case", mixed)


def citability(splits: DataFrame, complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of blocking codes and reasons over a pool; citable only when there are none."""
    out = splits.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("labels", text_array(PROMOTION_BARRED)))))).alias("blocking"),
        F.count_if(~F.col("citable")).alias("not_citable"),
    )
    out = out.join(complete, list(keys))
    why = reasons((F.col("not_citable") > 0, "SPLIT_NOT_CITABLE"), (F.size("blocking") > 0, "BLOCKING_LABEL"), (~F.col("complete"), "INCOMPLETE_POOL"))
    return out.withColumn("why", why).withColumn("citable", F.size("why") == 0)


def _open_and_places(x: DataFrame) -> tuple[int, int]:
    """Chains that have not ended, and the number of places they stand at."""
    r = x.agg(F.count("parent").alias("open"), F.count_distinct("parent").alias("places")).first()
    return r["open"], r["places"]


def _doubled(x: DataFrame) -> DataFrame:
    """Every open chain stands at its parent's parent and has its total; those that have ended are not joined.

    Written as a table: a checkpoint keeps its plan's estimate, whose digits would double with every join.
    """
    up = x.select(F.col("experiment").alias("parent"), F.col("parent").alias("_next"), F.col("total").alias("_more"))
    on = x.where(F.col("parent").isNotNull()).join(up, "parent", "left").select(
        "experiment", F.col("_next").alias("parent"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total")
    )
    return written(on.unionByName(x.where(F.col("parent").isNull()).select(on.columns)))


def trial_chain_count(experiments: DataFrame, trials: DataFrame) -> DataFrame:
    """Trials over each experiment's whole parent chain, by pointer doubling.

    Every round doubles the distance covered, so a chain of depth d needs log2(d) joins; each
    round is a table in the shared checkpoint folder. A parent that is not registered ends
    its chain. A round in which no chain ends leaves only chains that run into a cycle: ``state``
    says CYCLE, and each of its experiments counts once. The members of a cycle are told by
    following it from one of them; what leads into it adds its own path.
    """
    n = trials.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))
    base = experiments.select("experiment", "parent").join(n, "experiment", "left")
    base = written(base.select("experiment", "parent", F.coalesce("n", F.lit(0)).cast("bigint").alias("total")))
    is_open = F.col("parent").isNotNull()
    x, before, left = base, None, _open_and_places(base)
    # A chain that goes on has an ancestor that ends in this round, so without an end all that is open runs into cycles;
    # places that are no fewer after a round are mapped onto themselves, so they are the members of the cycles.
    while left[0] and left != before:
        x = _doubled(x)
        before, left = left, _open_and_places(x)
    done = x.where(~is_open).select("experiment", F.col("total").alias("chain_trials"), F.lit("ROOTED").alias("state"))
    if not left[0]:
        return done
    looped = written(x.where(is_open).select("experiment", F.col("parent").alias("_at")))
    ring = looped.select(F.col("_at").alias("experiment")).distinct()
    edges = written(base.join(ring, "experiment", "left_semi").select("experiment", "parent", "total"))
    # Minimum over the 1, 2, 4 ... next members names the cycle.
    walk = edges.select("experiment", F.col("parent").alias("_next"), F.least("experiment", "parent").alias("_name"))
    for _ in range(edges.count().bit_length()):
        ahead = walk.select(F.col("experiment").alias("_next"), F.col("_next").alias("_far"), F.col("_name").alias("_theirs"))
        walk = written(walk.join(ahead, "_next").select("experiment", F.col("_far").alias("_next"), F.least("_name", "_theirs").alias("_name")))
    named = written(walk.select("experiment", "_name").join(edges.select("experiment", "total"), "experiment"))
    sums = named.groupBy("_name").agg(F.sum("total").alias("_ring"))
    rings = named.join(sums, "_name").select("experiment", F.col("_ring").alias("chain_trials"))
    # Tails: the same doubling, where a cycle's member is a root that stands for its whole cycle.
    tail = base.join(looped.select("experiment"), "experiment", "left_semi").join(rings, "experiment", "left")
    tail = written(tail.select("experiment", F.when(F.col("chain_trials").isNull(), F.col("parent")).alias("parent"), F.coalesce("chain_trials", "total").alias("total")))
    while _open_and_places(tail)[0]:
        tail = _doubled(tail)
    return done.unionByName(tail.select("experiment", F.col("total").alias("chain_trials"), F.lit("CYCLE").alias("state")))


def promotion_eligibility(experiments: DataFrame, trials: DataFrame) -> DataFrame:
    """Blocking labels of an experiment or any of its trials; the holdout must have been opened."""
    barred = text_array(PROMOTION_BARRED)
    one = experiments.select("experiment", F.explode(F.array_intersect("labels", barred)).alias("code"))
    two = trials.select("experiment", F.explode(F.array_intersect("labels", barred)).alias("code"))
    codes = one.unionByName(two).groupBy("experiment").agg(F.array_sort(F.collect_set("code")).alias("blocking"))
    out = experiments.join(codes, "experiment", "left").withColumn("blocking", F.coalesce("blocking", F.array().cast("array<string>")))
    return out.withColumn("eligible", (F.size("blocking") == 0) & F.col("holdout_opened"))


def trial_conformance(trials: DataFrame, experiments: DataFrame) -> DataFrame:
    """Trials that depart from their frozen registration, with every reason."""
    e = experiments.select("experiment", F.col("commit").alias("_c"), "arms", "snapshots")
    x = trials.join(e, "experiment")
    why = reasons(
        (F.col("commit") != F.col("_c"), "COMMIT_MISMATCH"),
        (~F.array_contains("arms", F.col("arm")), "ARM_NOT_DECLARED"),
        (F.size(F.array_except("snapshot_ids", "snapshots")) > 0, "SNAPSHOT_NOT_REGISTERED"),
        (F.size("snapshot_ids") == 0, "NO_SNAPSHOT"),
        (F.col("finished") < F.col("started"), "REVERSED_TIMES"),
    )
    return x.withColumn("why", why).where(F.size("why") > 0).drop("_c", "arms", "snapshots")


def lineage_violations(experiments: DataFrame) -> DataFrame:
    """Roots registered after a sibling was viewed, and holdouts inherited from a parent that opened its own."""
    seen = experiments.groupBy("strategy").agg(F.min("viewed_at").alias("_seen"))
    parent = experiments.select(
        F.col("experiment").alias("parent"), F.col("holdout_opened_at").alias("_opened"), F.col("holdout_end").alias("_end")
    )
    x = experiments.join(seen, "strategy").join(parent, "parent", "left")
    why = reasons(
        (F.col("parent").isNull() & (F.col("_seen") < F.col("registered_at")), "PARENT_REQUIRED"),
        (F.col("_opened").isNotNull() & (F.col("holdout_start") <= F.col("_end")) & ~F.col("declares_opened"), "HOLDOUT_INHERITED"),
    )
    return x.withColumn("why", why).where(F.size("why") > 0).drop("_seen", "_opened", "_end")


def holdout_status(experiments: DataFrame, trials: DataFrame) -> DataFrame:
    """Counts of experiments, trials, viewed results, opened holdouts and claims per strategy."""
    n = trials.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))
    return experiments.join(n, "experiment", "left").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("experiments"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("trials"),
        F.count("viewed_at").alias("viewed"),
        F.count("holdout_opened_at").alias("opened"),
        F.count_if("claimed").alias("claimed"),
    )
