"""Benchmarks, performance measures and statistics over total-return series.

A series has one row per session, so windows per series are bounded by the calendar.
Benchmark and cash series join every arm; each is one row per session and is broadcast
on that bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knownwhen.functions.columns import first_true, ratio, reasons
from knownwhen.functions.statistics import EULER_MASCHERONI, PRIME, mix, normal_cdf, normal_quantile
from knownwhen.operators.market import by_entity

YEAR = 252
# A residual share of the total at or below this is no residual: cross products carry about 1e-15 of error.
DEGENERATE_FIT = 1e-12


def leg(series: DataFrame, entity: str, name: str) -> DataFrame:
    """One entity's levels as a dimension of at most one row per session."""
    return series.where(F.col("entity_id") == entity).select("session", F.col("tr_index").alias(name))


def common_levels(series: DataFrame, *legs: DataFrame) -> DataFrame:
    """Each arm's levels on the sessions it shares with every leg."""
    out = series
    for x in legs:
        out = out.join(F.broadcast(x), "session")
    return out


def step(level: str, keys=("entity_id",)) -> Column:
    prev = F.lag(level).over(Window.partitionBy(*keys).orderBy("session"))
    return ratio(F.col(level), prev) - 1


def compound(r: Column, keys=("entity_id",)) -> Column:
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(w)


def blend_series(levels: DataFrame, weight: Column) -> DataFrame:
    """Daily rebalanced blend of an arm and cash on their shared sessions; weight may vary by session."""
    out = levels.withColumn("_re", step("tr_index")).withColumn("_rc", step("cash_level"))
    r = weight * F.col("_re") + (1 - weight) * F.col("_rc")
    return out.withColumn("blend_return", r).withColumn("blend_index", compound(F.col("blend_return"))).drop("_re", "_rc")


def activation_instants(decisions: DataFrame, bars: DataFrame, delay: int) -> DataFrame:
    """Where each changed weight is acquired, on the entity's own bars, or why it cannot be.

    ``decisions`` carries entity, decision_session and weight; ``bars`` a tradable flag.
    """
    w = by_entity()
    good = F.when(F.col("tradable"), F.col("session"))
    ahead = F.first(good, ignorenulls=True).over(w.rowsBetween(max(delay, 1), Window.unboundedFollowing))
    at_close = F.when(F.col("tradable"), F.col("session")) if delay == 0 else F.lit(None).cast("date")
    b = bars.select("entity_id", F.col("session").alias("decision_session"), at_close.alias("_close"), ahead.alias("_open"), F.lit(True).alias("_bar"))
    x = decisions.join(b, ["entity_id", "decision_session"], "left")
    x = x.withColumn("acquired", F.coalesce("_close", "_open")).withColumn(
        "instant", F.when(F.col("_close").isNotNull(), "close").when(F.col("_open").isNotNull(), "open")
    )
    before = Window.partitionBy("entity_id").orderBy("decision_session").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("acquired").isNotNull(), F.col("weight")), ignorenulls=True).over(before)
    x = x.withColumn("_prev", prev).where(F.col("_prev").isNull() | (F.col("weight") != F.col("_prev")))
    issue = first_true((F.col("_bar").isNull(), "NO_BAR_AT_DECISION"), (F.col("acquired").isNull(), "NO_TRADABLE_BAR"))
    return x.withColumn("issue", issue).drop("_close", "_open", "_bar", "_prev")


def vol_target_index(equity: DataFrame, cash: DataFrame, activations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Index whose equity weight steps at acquisition instants.

    A weight acquired at an open splits that session: the old weight earns up to the open
    with the distribution, the new one from the open on price alone. A weight acquired at
    a close counts from the next step. ``issues`` names what could not be placed exactly.
    ``equity`` and ``cash`` carry tr_index, adj_close, distribution, open, close; cash is
    one series. ``sessions`` is the expected calendar with a dense index.
    """
    w = by_entity()

    def own(df: DataFrame, p: str, win) -> DataFrame:
        cols = ["tr_index", "adj_close", "distribution", "open", "close"]
        out = df.select(*[x for x in ("entity_id",) if p == "e"], "session", *[F.col(x).alias(f"{p}_{x}") for x in cols])
        return out.withColumn(f"{p}_last_tr", F.lag(f"{p}_tr_index").over(win)).withColumn(
            f"{p}_last_adj", F.lag(f"{p}_adj_close").over(win)
        )

    x = own(equity, "e", w).join(F.broadcast(own(cash, "c", Window.orderBy("session"))), "session")
    x = x.join(F.broadcast(sessions.select("session", "idx")), "session", "left")
    x = x.withColumn("_prev", F.lag("session").over(w)).withColumn("_skip", F.col("idx") - F.lag("idx").over(w) - 1)
    for p in ("e", "c"):
        x = x.withColumn(f"{p}_prev_tr", F.lag(f"{p}_tr_index").over(w))

    # Every activation goes to the first shared session at or after it, found on one time line.
    a = activations.select(
        "entity_id", F.col("acquired").alias("session"), "instant", "weight",
        F.coalesce(F.lag("weight").over(Window.partitionBy("entity_id").orderBy("acquired", F.col("instant").desc())), F.lit(0.0)).alias("running"),
    )
    line = x.select("entity_id", "session", F.lit(None).cast("string").alias("instant"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("running"))
    line = line.unionByName(a.select("entity_id", "session", "instant", "weight", "running"))
    mark = F.when(F.col("instant").isNull(), F.col("session"))
    ahead = Window.partitionBy("entity_id").orderBy("session", F.col("instant").isNull().cast("int")).rowsBetween(0, Window.unboundedFollowing)
    placed = line.withColumn("_at", F.first(mark, ignorenulls=True).over(ahead)).where(F.col("instant").isNotNull())
    order = F.struct("session", (F.col("instant") == "close").cast("int"))
    closes = (F.col("instant") == "close") & (F.col("session") == F.col("_at"))
    exact = (F.col("instant") == "open") & (F.col("session") == F.col("_at"))
    late = placed.where(F.col("_at").isNull() & (F.col("weight") != F.col("running"))).groupBy("entity_id").agg(F.count(F.lit(1)).alias("_late"))
    acts = placed.where(F.col("_at").isNotNull()).groupBy("entity_id", F.col("_at").alias("session")).agg(
        F.max_by(F.when(~closes, F.col("weight")), F.when(~closes, order)).alias("at_open"),
        F.max_by(F.when(closes, F.col("weight")), F.when(closes, order)).alias("at_close"),
        F.max(~closes & ~exact & (F.col("weight") != F.col("running"))).alias("_inside"),
    )
    x = x.join(acts, ["entity_id", "session"], "left")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.last(F.coalesce("at_close", "at_open"), ignorenulls=True).over(upto), F.lit(0.0))
    x = x.withColumn("weight_before", old)
    moved = F.col("_prev").isNotNull() & F.col("at_open").isNotNull() & (F.col("at_open") != F.col("weight_before"))
    parts = {}
    usable = F.lit(True)
    for p in ("e", "c"):
        adj_open = F.col(f"{p}_open") * F.col(f"{p}_adj_close") / F.nullif(F.col(f"{p}_close"), F.lit(0.0))
        carry = F.col(f"{p}_last_tr") / F.nullif(F.col(f"{p}_prev_tr"), F.lit(0.0))
        parts[p] = (carry * (adj_open + F.col(f"{p}_distribution")) / F.col(f"{p}_last_adj"), F.col(f"{p}_adj_close") / adj_open)
        for v in (F.col(f"{p}_open"), F.col(f"{p}_close"), F.col(f"{p}_last_adj"), F.col(f"{p}_last_tr"), F.col(f"{p}_prev_tr")):
            usable = usable & F.coalesce(v > 0, F.lit(False))
    w0, w1 = F.col("weight_before"), F.col("at_open")
    plain = w0 * F.col("e_tr_index") / F.col("e_prev_tr") + (1 - w0) * F.col("c_tr_index") / F.col("c_prev_tr")
    over = w0 * parts["e"][0] + (1 - w0) * parts["c"][0]
    intra = w1 * parts["e"][1] + (1 - w1) * parts["c"][1]
    factor = F.when(F.col("_prev").isNull(), 1.0).when(moved & usable, over * intra).otherwise(plain)
    issues = reasons(
        (F.coalesce(F.col("_inside"), F.lit(False)) & F.col("_prev").isNotNull(), "INSIDE_INTERVAL"),
        ((F.col("_skip") > 0) & (w0 != 0) & (w0 != 1), "SKIPPED_SESSION"),
        (moved & ~usable, "NO_USABLE_OPEN"),
    )
    x = x.withColumn("_factor", factor).withColumn("issues", issues)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("level", F.product("_factor").over(run)).join(late, "entity_id", "left")
    whole = Window.partitionBy("entity_id")
    broken = F.max(F.size("issues") > 0).over(whole) | F.col("_late").isNotNull()
    return x.select("entity_id", "session", "weight_before", "level", "issues", (~broken).alias("exact"))


def cagr(first: Column, last: Column, days: Column) -> Column:
    """Compound annual growth; a total loss is -1."""
    growth = ratio(last, first)
    return F.when(growth <= 0, F.lit(-1.0)).otherwise(F.pow(growth, 365.25 / F.nullif(days, F.lit(0)).cast("double")) - 1)


def span_cagr(series: DataFrame, keys=("entity_id",)) -> DataFrame:
    days = F.datediff(F.max("session"), F.min("session"))
    return series.groupBy(*keys).agg(cagr(F.min_by("tr_index", "session"), F.max_by("tr_index", "session"), days).alias("cagr"))


def drawdown(level: str = "tr_index", keys=("entity_id",)) -> Column:
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return ratio(F.col(level), F.max(level).over(w)) - 1


def max_drawdown(series: DataFrame, level: str = "tr_index", keys=("entity_id",)) -> DataFrame:
    return series.withColumn("_dd", drawdown(level, keys)).groupBy(*keys).agg(F.min("_dd").alias("max_drawdown"))


def sharpe(x: Column) -> Column:
    """Annualised mean over deviation of paired excess returns, 0 without deviation."""
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / sd * np.sqrt(YEAR)).otherwise(0.0)


def turnover(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """Absolute traded notional over average NAV, per year of the NAV span."""
    years = F.datediff(F.max("session"), F.min("session")) / 365.25
    n = nav.groupBy("account").agg(F.avg("nav").alias("_nav"), years.alias("_years"))
    t = trades.groupBy("account").agg(F.sum(F.abs("notional")).alias("_traded"))
    out = n.join(t, "account", "left")
    rate = ratio(F.coalesce("_traded", F.lit(0.0)), F.col("_nav") * F.col("_years"))
    return out.select("account", F.when(F.col("_nav") > 0, rate).alias("turnover"))


def arm_metrics(levels: DataFrame, window: int = 21) -> DataFrame:
    """All per-arm measures in one aggregation over prepared columns.

    ``levels`` are an arm's levels with ``cash_level`` and ``primary_level`` (null where the
    leg has no point). Excess is taken on sessions shared with the leg.
    """
    w = by_entity()
    x = levels.withColumn("_r", step("tr_index")).withColumn("_dd", drawdown())
    x = x.withColumn("_roll", ratio(F.col("tr_index"), F.lag("tr_index", window).over(w)) - 1)
    for name in ("cash", "primary"):
        on = F.col(f"{name}_level").isNotNull()
        shared = Window.partitionBy("entity_id", on).orderBy("session")
        own = ratio(F.col("tr_index"), F.lag("tr_index").over(shared))
        other = ratio(F.col(f"{name}_level"), F.lag(f"{name}_level").over(shared))
        x = x.withColumn(f"_x_{name}", F.when(on, own - other))
    first, last = F.min_by("tr_index", "session"), F.max_by("tr_index", "session")
    days = F.datediff(F.max("session"), F.min("session"))
    out = x.groupBy("entity_id").agg(
        (ratio(last, first) - 1).alias("total_return"),
        cagr(first, last, days).alias("cagr"),
        (F.stddev_samp(F.ln(1 + F.col("_r"))) * np.sqrt(YEAR)).alias("volatility"),
        F.min("_dd").alias("max_drawdown"),
        sharpe(F.col("_x_cash")).alias("sharpe"),
        sharpe(F.col("_x_primary")).alias("information_ratio"),
        F.min("_roll").alias("worst_21"),
        F.percentile("_r", F.lit(0.01)).alias("p01"),
        F.percentile("_r", F.lit(0.05)).alias("p05"),
        F.count(F.lit(1)).alias("sessions"),
    )
    return out.withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown")))


def sharpe_inputs(levels: DataFrame, expected: DataFrame) -> DataFrame:
    """Paired daily excess returns of an arm and the primary over cash.

    Levels are aligned before differencing, and an interval that swallows an expected
    session is dropped. ``levels`` hold only sessions all three share; ``expected`` is the
    union of sessions with a dense index.
    """
    w = by_entity()
    x = levels.join(F.broadcast(expected.select("session", "idx")), "session")
    x = x.withColumn("_gap", F.col("idx") - F.lag("idx").over(w))
    cash = step("cash_level")
    x = x.withColumn("strategy", step("tr_index") - cash).withColumn("benchmark", step("primary_level") - cash)
    return x.where(F.col("_gap") == 1).select("entity_id", "session", "strategy", "benchmark")


def tax_scenarios(realized: DataFrame, initial_cash: float, short_rate: float, long_rate: float) -> DataFrame:
    """Tax on realised gains by scenario and its drag on the initial cash; gains unsold stay untaxed."""
    tax = F.col("short_term") * short_rate + F.col("long_term") * long_rate
    rows = F.array(
        F.struct(F.lit("tax_deferred").alias("scenario"), F.lit(0.0).alias("tax")),
        F.struct(F.lit("taxable_short_long_split").alias("scenario"), tax.alias("tax")),
    )
    return realized.select("account", F.explode(rows).alias("s")).select(
        "account", "s.*", (F.col("s.tax") / initial_cash).alias("drag")
    )


def moments(rows: DataFrame, value: str, keys=("entity_id",)) -> DataFrame:
    """Mean, deviation and bias-corrected skewness and excess kurtosis.

    The engine's own skewness and kurtosis are population forms; the sample factors are
    applied here.
    """
    m = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"),
    )
    n = F.col("n").cast("double")
    flat = F.coalesce(F.col("sd") == 0, F.lit(True))
    skew = F.when((n < 3) | flat, 0.0).otherwise(F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when((n < 4) | flat, 0.0).otherwise(
        (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6)
    )
    return m.withColumn("skew", skew).withColumn("kurt", kurt).drop("_g1", "_g2")


def quantiles(rows: DataFrame, value: str, ps: tuple[float, ...], keys=("entity_id",)) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(f"q{int(p * 100):02d}") for p in ps])


def bootstrap_indices(n: int, resamples: np.ndarray, block: int, seed: int) -> np.ndarray:
    """Stationary-bootstrap row numbers from a counter hash: one row of n per resample.

    Every draw depends only on (seed, resample, position), so any task can make any of them.
    """
    t = np.arange(n, dtype=np.int64)
    base = (seed * 7919 + resamples.astype(np.int64)[:, None] * 1000003) % PRIME
    restart = mix((base + t * 2 + 1) % PRIME) * block < PRIME
    restart[:, 0] = True
    begin = mix((base + t * 2 + 2) % PRIME) % n
    at = np.maximum.accumulate(np.where(restart, t, 0), axis=1)
    return (np.take_along_axis(begin, at, axis=1) + t - at) % n


def _mean_stat(a: np.ndarray) -> np.ndarray:
    return a.mean(axis=1)


def _sharpe_stat(a: np.ndarray) -> np.ndarray:
    sd = a.std(axis=1, ddof=1)
    return np.where(sd > 0, a.mean(axis=1) / np.where(sd > 0, sd, 1) * np.sqrt(YEAR), 0.0)


def block_bootstrap(series: DataFrame, values: list[str], stat: str, *, resamples: int, block: int = 21, seed: int = 1, confidence: float = 0.90, keys=("entity_id",), chunk: int = 50) -> DataFrame:
    """Stationary block bootstrap of a series' mean, Sharpe or paired Sharpe difference.

    A series is one array (bounded by the calendar); it is sent once per chunk of resamples,
    so the work spreads over series x chunks and only one number per resample comes back.
    The estimator is the published one; draws come from a counter hash, which any engine
    can reproduce, rather than a sequential generator.
    """

    @F.pandas_udf("array<double>")
    def draw(chunk_no: pd.Series, *cols: pd.Series) -> pd.Series:
        out = []
        for i in range(len(chunk_no)):
            first = int(chunk_no.iloc[i]) * chunk
            rs = np.arange(first, min(first + chunk, resamples))
            xs = [np.asarray(c.iloc[i], dtype=float) for c in cols]
            idx = bootstrap_indices(len(xs[0]), rs, block, seed)
            if stat == "mean":
                got = _mean_stat(xs[0][idx])
            else:
                got = _sharpe_stat(xs[0][idx])
                if len(xs) > 1:
                    got = got - _sharpe_stat(xs[1][idx])
            out.append(got)
        return pd.Series(out)

    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("session", *values))).alias("_s"))
    parts = -(-resamples // chunk)
    rows = packed.where(F.size("_s") > 1).select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_chunk"), *[F.col(f"_s.{v}").alias(v) for v in values]
    )
    rows = rows.repartition(*keys, "_chunk")
    stats = rows.select(*keys, F.explode(draw("_chunk", *values)).alias("_v"))
    tail = (1 - confidence) / 2
    out = stats.groupBy(*keys).agg(
        F.avg("_v").alias("boot_mean"), F.percentile("_v", F.lit(tail)).alias("lower"), F.percentile("_v", F.lit(1 - tail)).alias("upper")
    )
    return out.withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0))


def deflated_sharpe(rows: DataFrame) -> DataFrame:
    """Probability that an observed Sharpe beats the expected best of N trials.

    ``rows`` carries sharpe, trial_sd, trials, n, skew, kurt. Withheld with notes where the
    assumptions fail.
    """
    notes = reasons(
        (F.col("trials") < 2, "FEWER_THAN_TWO_TRIALS"),
        (F.col("n") < 60, "TOO_FEW_OBSERVATIONS"),
        (F.coalesce(F.col("trial_sd") <= 0, F.lit(True)), "NO_DISPERSION"),
        (F.abs("kurt") > 10, "KURTOSIS_OUT_OF_RANGE"),
    )
    k = F.col("trials").cast("double")
    za = normal_quantile(1 - 1 / k)
    zb = normal_quantile(1 - 1 / (k * float(np.e)))
    best = F.col("trial_sd") * ((1 - EULER_MASCHERONI) * za + EULER_MASCHERONI * zb)
    sr, top = F.col("sharpe") / np.sqrt(YEAR), F.col("_best") / np.sqrt(YEAR)
    var = (1 - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr) / (F.col("n") - 1)
    out = rows.withColumn("notes", notes).withColumn("_ok", F.size("notes") == 0)
    out = out.withColumn("_best", F.when(F.col("_ok"), best)).withColumn("_var", F.when(F.col("_ok"), var))
    bad = F.col("_ok") & (F.col("_var") <= 0)
    return (
        out.withColumn("notes", F.when(bad, F.array(F.lit("NON_POSITIVE_VARIANCE"))).otherwise(F.col("notes")))
        .withColumn("expected_max", F.col("_best"))
        .withColumn("deflated", F.when(F.col("_var") > 0, normal_cdf((sr - top) / F.sqrt("_var"))))
        .drop("_ok", "_best", "_var")
    )


def concentration(contrib: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Shares of a strategy's total excess by best securities, year and episode.

    ``contrib`` is (strategy, security, year, episode, value). Each axis is summed first, so
    the ranking windows see one row per security.
    """
    by = contrib.groupBy("strategy", "security").agg(F.sum("value").alias("_v"))
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.col("_v").desc(), "security"))
    by = by.withColumn("_rk", rank)
    tops = by.groupBy("strategy").agg(
        F.sum("_v").alias("total"),
        *[F.sum(F.when(F.col("_rk") <= k, F.col("_v"))).alias(f"_top{k}") for k in (1, 3, 5)],
        F.array_sort(F.collect_list(F.when(F.col("_rk") <= 5, F.struct("_rk", "security")))).alias("_names"),
    )
    for axis in ("year", "episode"):
        g = contrib.groupBy("strategy", axis).agg(F.sum("value").alias("_v"))
        best = g.groupBy("strategy").agg(F.max(F.struct("_v", axis)).alias("_m")).select("strategy", F.col(f"_m.{axis}").alias(f"best_{axis}"), F.col("_m._v").alias(f"_{axis}"))
        tops = tops.join(best, "strategy", "left")

    def share(x: str) -> Column:
        return F.when(F.col("total") > 0, F.col(x) / F.col("total")).otherwise(0.0)

    out = tops.select(
        "strategy", "total", share("_top1").alias("top1"), share("_top3").alias("top3"), share("_top5").alias("top5"),
        F.array_join(F.col("_names.security"), ",").alias("securities"), "best_year", share("_year").alias("year_share"),
        "best_episode", share("_episode").alias("episode_share"),
    )
    return out.withColumn("concentrated", F.greatest("top1", "year_share", "episode_share") > threshold)


def regime_labels(series: DataFrame, level: str = "tr_index", threshold: float = 0.10) -> DataFrame:
    """Drawdown, recovery or calm from the trailing peak; recovery lasts until the peak is regained."""
    w = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumn("_peak", F.max(level).over(w))
    x = x.withColumn("_run", F.sum((F.col(level) >= F.col("_peak")).cast("int")).over(w))
    x = x.withColumn("_dd", 1 - F.col(level) / F.nullif("_peak", F.lit(0.0)))
    deep = F.col("_dd") > threshold
    within = Window.partitionBy("entity_id", "_run").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    regime = F.when(deep, "BENCHMARK_DRAWDOWN").when(F.max(deep).over(within), "BENCHMARK_RECOVERY").otherwise("BENCHMARK_CALM")
    return x.where(F.col("_peak") > 0).withColumn("regime", regime).drop("_peak", "_run", "_dd")


def exposure_attribution(levels: DataFrame, weight: Column) -> DataFrame:
    """Timing, selection and the cross term of an arm against a benchmark and its exposure-matched blend.

    ``levels`` carries tr_index, primary_level and matched_level on their shared sessions.
    """

    def total(x: str) -> Column:
        return ratio(F.max_by(x, "session"), F.min_by(x, "session")) - 1

    out = levels.groupBy("entity_id").agg(
        total("tr_index").alias("strategy"), total("primary_level").alias("benchmark"), total("matched_level").alias("matched"),
        F.avg(weight).alias("average_weight"), F.count(F.lit(1)).alias("sessions"),
    )
    out = out.withColumn("timing", F.col("matched") - F.col("benchmark")).withColumn("selection", F.col("strategy") - F.col("matched"))
    return out.withColumn("cross_term", (F.col("strategy") - F.col("benchmark")) - (F.col("timing") + F.col("selection")))


def factor_regression(rows: DataFrame, y: str, xs: list[str], keys=("entity_id",)) -> DataFrame:
    """Least squares with standard errors, t-values and R2 per group.

    Spark sums the cross products, one row of (k+1)^2 numbers per group; a vectorised step
    solves the small systems. Too few rows for a residual variance or collinear factors are
    ``refused``; a fit that leaves no residual is ``degenerate``.
    """
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(cols)
    ok = rows.where(F.col(y).isNotNull())
    for x in xs:
        ok = ok.where(F.col(x).isNotNull())
    sums = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("_xx"),
        F.array(*[F.sum(a * F.col(y)) for a in cols]).alias("_xy"),
        F.sum(F.col(y) * F.col(y)).alias("_yy"),
        F.sum(y).alias("_sy"),
    )

    @F.pandas_udf("coef array<double>, se array<double>, r2 double, refused boolean, degenerate boolean")
    def solve(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, sy: pd.Series) -> pd.DataFrame:
        out = []
        for m, a, b, q, s in zip(n, xx, xy, yy, sy, strict=True):
            a, b = np.asarray(a).reshape(k, k), np.asarray(b)
            scale = np.sqrt(np.diag(a))
            bad = m < k + 1 or bool((scale == 0).any()) or np.linalg.cond(a / np.outer(scale, scale)) > 1e12
            if bad:
                out.append((None, None, None, True, None))
                continue
            coef = np.linalg.solve(a, b)
            rss, tss = max(q - coef @ b, 0.0), max(q - s * s / m, 0.0)
            se = np.sqrt(np.maximum(np.diag(np.linalg.inv(a)) * rss / (m - k), 0.0))
            exact = rss <= DEGENERATE_FIT * tss if tss > 0 else rss == 0
            out.append((coef.tolist(), se.tolist(), 1 - rss / tss if tss > 0 else 0.0, False, bool(exact)))
        return pd.DataFrame(out, columns=["coef", "se", "r2", "refused", "degenerate"])

    out = sums.withColumn("_f", solve("n", "_xx", "_xy", "_yy", "_sy")).select(*keys, "n", "_f.*")
    return out.withColumn("t", F.zip_with("coef", "se", lambda a, b: F.when(b > 0, a / b).otherwise(0.0)))


def factor_attribution(monthly: DataFrame, xs: list[str], *, min_months: int = 24, resamples: int = 2000, keys=("entity_id",)) -> DataFrame:
    """Monthly excess on factors, with an alpha interval from bootstrapped residuals.

    Groups with fewer months are reported as not performed.
    """
    fit = factor_regression(monthly, "excess", xs, keys)
    done = fit.where((F.col("n") >= min_months) & ~F.col("refused"))
    fitted = F.col("coef")[0]
    for i, x in enumerate(xs):
        fitted = fitted + F.col("coef")[i + 1] * F.col(x)
    res = monthly.join(done, list(keys)).withColumn("residual", F.col("excess") - fitted)
    res = res.withColumnRenamed("month", "session").select(*keys, "session", "residual")
    boot = block_bootstrap(res, ["residual"], "mean", resamples=resamples, block=3, keys=keys)
    out = fit.join(boot, list(keys), "left")
    alpha = F.col("coef")[0]
    return out.select(
        *keys, "n", F.when(F.col("n") >= min_months, alpha).alias("alpha"), (alpha + F.col("lower")).alias("alpha_lower"),
        (alpha + F.col("upper")).alias("alpha_upper"), "r2",
        F.when((F.col("n") < min_months) | F.col("refused"), "NOT_PERFORMED").otherwise("PERFORMED").alias("status"),
    )
