"""Aggregates with explicit denominators: shares, agreement, thresholds, fits, summaries by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.contract import finite
from quern.operators.prefix import prefix_sums
from quern.operators.ranking import quantile_rows, quantiles
from quern.plans.staging import broadcast_checked, stage


def group_size_histogram(df: DataFrame, group: str) -> DataFrame:
    """(group_size, n_groups, n_rows): how many groups have each size; null groups are left out."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups")).withColumn("n_rows", F.col("group_size") * F.col("n_groups"))


def exclusion_counters(df: DataFrame, by: str, reasons: dict[str, Column], censored: Column) -> DataFrame:
    """For each value of ``by``: seen rows, rows of each reason, censored rows and their share of the seen, not of survivors."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(c).alias(k) for k, c in reasons.items()], F.count_if(censored).alias("censored"))
    return out.withColumn("censored_share", F.try_divide("censored", "seen"))


def quantile_function(df: DataFrame, value: str, knots: int = 101) -> DataFrame:
    """(knot, q, value) of the exact, linearly interpolated quantile function, made monotone by a running maximum."""
    rows = quantile_rows(df, [], value, {f"k{i}": i / (knots - 1) for i in range(knots)})
    each = rows.select(F.substring("name", 2, 9).cast("int").alias("knot"), "q", "quantile")
    return each.select("knot", "q", F.max("quantile").over(Window.orderBy("knot")).alias("value"))


def degenerate_reason(n: Column, distinct: Column, p01: Column, p99: Column, least: int = 32, ratio: float = 1.05) -> Column:
    """Why a distribution can't be drawn from, or null: too few rows, too few values, or hardly any spread."""
    return F.when(n < least, "too_few_rows").when(distinct < least, "too_few_values").when((p01 <= 0) | (F.try_divide(p99, p01) < ratio), "no_spread")


def distribution_checks(df: DataFrame, value: str, route: str, censored: str, least: int = 32, least_of_route: int = 8, most_censored: float = 0.25) -> DataFrame:
    """(route, n, distincts, censored_share, p01, p99, reason) of the positive finite values: for all together (route null), which
    need ``least`` rows and values, and for each route, which needs least_of_route values; a share of censored rows (null
    counts as none) above most_censored is a reason too. Rows of a null route count in the whole only."""
    ok = stage(df.where(finite(F.col(value)) & (F.col(value) > 0)).select(F.col(route).alias("route"), F.col(value).cast("double").alias("v"), F.coalesce(F.col(censored), F.lit(False)).alias("cens")), "values")
    aggs = [F.countDistinct("v").alias("distincts"), F.avg(F.col("cens").cast("double")).alias("censored_share")]
    ends = {"p01": 0.01, "p99": 0.99}
    whole = quantiles(ok, [], "v", ends).join(F.broadcast(ok.agg(*aggs))).withColumn("route", F.lit(None).cast("string"))
    known = ok.where("route is not null")
    each = quantiles(known, ["route"], "v", ends).join(known.groupBy("route").agg(*aggs), "route")
    too_many = F.when(F.col("censored_share") > most_censored, "too_many_censored")
    whole = whole.withColumn("reason", F.coalesce(degenerate_reason(F.col("n"), F.col("distincts"), F.col("p01"), F.col("p99"), least), too_many))
    each = each.withColumn("reason", F.coalesce(F.when(F.col("distincts") < least_of_route, "too_few_values"), too_many))
    return whole.unionByName(each).select("route", "n", "distincts", "censored_share", "p01", "p99", "reason")


def threshold_proposals(df: DataFrame, metric: str, value: str, percents: list[int]) -> DataFrame:
    """(metric, percent, cutoff, dropped, dropped_share): nearest-rank cutoffs of each metric and the rows below each of them."""
    ok = stage(df.where(finite(F.col(value))).select(metric, value), "measured")
    q = quantiles(ok, [metric], value, {f"p{p}": p / 100 for p in percents}, "nearest")
    cuts = broadcast_checked(q.select(metric, F.col("n").alias("_n"), F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("cutoff")) for p in percents])).alias("x")).select(metric, "_n", "x.percent", "x.cutoff"))
    met = ok.join(cuts, metric).groupBy(metric, "percent", "cutoff", "_n").agg(F.count_if(F.col(value) < F.col("cutoff")).alias("dropped"))
    return met.withColumn("dropped_share", F.col("dropped") / F.col("_n")).drop("_n")


def stable_threshold(df: DataFrame, score: str, good: str, precision: float) -> DataFrame:
    """One row: the smallest cutoff such that it and every higher one keep rows of at least that precision; empty if none does.

    Counts are aggregated by score and accumulated from the top by partition prefixes.
    """
    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(good).isNotNull())
    freq = ok.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(good)).alias("_g"))
    run = stage(prefix_sums(freq, [], [F.col(score).desc()], ["_n", "_g"]), "from_top")
    run = run.withColumn("precision", F.col("cum__g") / F.col("cum__n"))
    bad = run.agg(F.max(F.when(F.col("precision") < precision, F.col(score))).alias("_bad"), F.max("cum__g").alias("_all"))
    met = run.join(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(score) > F.col("_bad")))
    best = F.min_by(F.struct(F.col(score).alias("threshold"), "precision", (F.col("cum__g") / F.col("_all")).alias("recall"), F.col("cum__n").alias("retained")), F.col(score))
    return met.agg(best.alias("x")).where("x is not null").select("x.*")


def agreement(df: DataFrame, ratio: str, scene: str) -> DataFrame:
    """(level, n, within_10, within_25, within_50, p05, median, p95): agreement of a ratio with 1, by row and by the median of
    each scene."""
    rows = df.where(finite(F.col(ratio))).select(F.lit("row").alias("level"), F.col(ratio).alias("r"))
    scenes = quantiles(df.where(F.col(scene).isNotNull()), [scene], ratio, {"r": 0.5}).select(F.lit("scene").alias("level"), "r")
    both = stage(rows.unionByName(scenes), "ratios")
    within = [F.avg((F.abs(F.col("r") - 1) <= w / 100).cast("double")).alias(f"within_{w}") for w in (10, 25, 50)]
    return both.groupBy("level").agg(*within).join(quantiles(both, ["level"], "r", {"p05": 0.05, "median": 0.5, "p95": 0.95}), "level")


def paired_counts(df: DataFrame, before: str, after: str, eps: float = 1e-9) -> DataFrame:
    """One row: pairs with both values finite, and those whose value got smaller (improved), larger (worse) or stayed (tied)."""
    d = F.col(after) - F.col(before)
    x = df.where(finite(F.col(before)) & finite(F.col(after)))
    return x.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(d < -eps).alias("improved"), F.count_if(d > eps).alias("worse"), F.count_if(F.abs(d) <= eps).alias("tied"), F.avg(d).alias("mean_delta"))


def rescaled_by_median(df: DataFrame, ratio: str, by: str) -> DataFrame:
    """For each group the mean ratio as it is and after division by the global median: what one common factor explains."""
    mid = quantiles(df, [], ratio, {"_mid": 0.5}).select("_mid")
    x = df.where(finite(F.col(ratio))).join(F.broadcast(mid))
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("mean_ratio"), F.avg(F.col(ratio) / F.col("_mid")).alias("rescaled"))


def summary_upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, upper median (element n // 2), least and most of the non-null values, and the failures (nulls) beside them."""
    base = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(F.col(value).isNull()).alias("failures"))
    mid = quantiles(df, by, value, {"upper_median": 0.5}, "upper").drop("n")
    return base.join(broadcast_checked(mid), by, "left")


def scene_mean_error(df: DataFrame, scene: str, value: str, by: list[str]) -> DataFrame:
    """Mean of scene means and its standard error, sd / sqrt(scenes), over finite values."""
    m = df.where(finite(F.col(value)) & F.col(scene).isNotNull()).groupBy(*by, scene).agg(F.avg(value).alias("_m"))
    return m.groupBy(*by).agg(F.count(F.lit(1)).alias("scenes"), F.avg("_m").alias("mean"), F.try_divide(F.stddev_samp("_m"), F.sqrt(F.count(F.lit(1)))).alias("sem"))


def guarded_corr(a: Column, b: Column, constant: float | None = 0.0) -> Column:
    """Aggregate: Pearson correlation of the pairs with both values, ``constant`` where either doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.coalesce(r, F.lit(constant).cast("double"))


def affine_fit(x: str, y: str) -> list[Column]:
    """Aggregates slope, intercept and r2 of the least-squares line y = slope x + intercept; null where x doesn't vary."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def line_with_residual(df: DataFrame, by: str, x: str, y: str, tolerance: float) -> DataFrame:
    """The fitted line of each group, its largest absolute residual, and whether that stays within tolerance of y's largest."""
    fit = df.groupBy(by).agg(*affine_fit(x, y), F.max(F.abs(y)).alias("_top"))
    met = df.join(fit, by).withColumn("_e", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")))
    out = met.groupBy(by, "slope", "intercept", "r2", "_top").agg(F.max("_e").alias("max_residual"))
    return out.withColumn("linear", F.col("max_residual") <= tolerance * F.col("_top")).drop("_top")


def affine_metrics(df: DataFrame, by: str, pred: str, target: str) -> DataFrame:
    """Depth metrics of each group after the least-squares fit of pred to target: abs_rel, sq_rel, rmse, rmse_log, log10, d1..d3.

    Rows with target > 1e-6 count; values below 1e-6 are raised to it; pred's variance is at least 1e-8.
    """
    ok = df.where(finite(F.col(pred)) & finite(F.col(target)))
    fit = ok.groupBy(by).agg(F.covar_pop(pred, target).alias("_c"), F.var_pop(pred).alias("_v"), F.avg(pred).alias("_mp"), F.avg(target).alias("_mt"))
    slope = F.col("_c") / F.greatest(F.col("_v"), F.lit(1e-8))
    p = F.greatest(slope * (F.col(pred) - F.col("_mp")) + F.col("_mt"), F.lit(1e-6))
    x = ok.join(fit, by).where(F.col(target) > 1e-6).select(by, p.alias("p"), F.greatest(F.col(target), F.lit(1e-6)).alias("t"))
    d, ratio = F.col("p") - F.col("t"), F.greatest(F.col("p") / F.col("t"), F.col("t") / F.col("p"))
    log = F.log("p") - F.log("t")
    return x.groupBy(by).agg(
        F.avg(F.abs(d) / F.col("t")).alias("abs_rel"), F.avg(d * d / F.col("t")).alias("sq_rel"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(log * log)).alias("rmse_log"),
        F.avg(F.abs(log) / F.lit(2.302585092994046)).alias("log10"), *[F.avg((ratio < 1.25**k).cast("double")).alias(f"d{k}") for k in (1, 2, 3)],
    )


def margin_over(df: DataFrame, bench: str, arm: str, value: str, baseline: str) -> DataFrame:
    """(bench, arm, value, margin): each arm's value less the baseline arm's of the same bench; null without one."""
    base = df.where(F.col(arm) == baseline).groupBy(bench).agg(F.max(value).alias("_b"))
    return df.select(bench, arm, value).join(base, bench, "left").withColumn("margin", F.col(value) - F.col("_b")).drop("_b")


def seed_deltas(df: DataFrame, seed: str, arm: str, value: str, baseline: str) -> DataFrame:
    """For each arm: seeds in common with the baseline, mean and sd of the paired differences, seeds in its favour (wins)."""
    base = df.where(F.col(arm) == baseline).select(seed, F.col(value).alias("_b"))
    d = df.where(F.col(arm) != baseline).join(base, seed).withColumn("_d", F.col(value) - F.col("_b"))
    return d.groupBy(arm).agg(F.count("_d").alias("seeds"), F.avg("_d").alias("mean_delta"), F.stddev_samp("_d").alias("sd_delta"), F.count_if(F.col("_d") > 0).alias("wins"))


def best_row(df: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of highest value of each group, ties to the smallest of the tie columns."""
    rest = [c for c in df.columns if c not in by]
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*by, *rest)


def size_inventory(df: DataFrame, by: str, item: str, size: str) -> DataFrame:
    """For each group: its sorted distinct items, rows and bytes."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("total_size"))


def moving_scale(df: DataFrame, by: str, order: str, value: str, decay: float = 0.9, jump: float = 10.0, freeze_after: int | None = None) -> DataFrame:
    """Exponential moving average of each series in order, one fold over its values; a value of more than ``jump`` times the
    average is held at that bound, and after freeze_after steps the scale stays as it is. A series is bounded by its number of
    steps; gives the final scale and the steps."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        held = F.least(x["v"], F.lit(jump) * acc["s"])
        new = F.when(acc["s"].isNull(), x["v"]).otherwise(F.lit(decay) * acc["s"] + F.lit(1 - decay) * held)
        return F.struct((new if freeze_after is None else F.when(acc["k"] >= freeze_after, acc["s"]).otherwise(new)).alias("s"), (acc["k"] + 1).alias("k"))

    return df.where(finite(F.col(value))).groupBy(by).agg(F.aggregate(seq, start, step).alias("x")).select(by, F.col("x.s").alias("scale"), F.col("x.k").alias("steps"))


def spread_by_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, share, mean, sd, p05, median, p95) of each group's finite values; share is that of all of them, sd is null for one
    value. A null group counts in the shares' whole only if it has rows, under null."""
    ok = stage(df.where(finite(F.col(value))).select(by, F.col(value).cast("double").alias("_x")), "values")
    total = ok.agg(F.count(F.lit(1)).alias("_all"))
    mean = ok.groupBy(F.col(by).alias("_b")).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"))
    q = quantiles(ok, [by], "_x", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return q.join(mean, F.col(by).eqNullSafe(F.col("_b"))).join(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("_all")).alias("share"), "mean", "sd", "p05", "median", "p95")
