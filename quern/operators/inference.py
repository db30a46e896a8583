"""Intervals and tests over scene sums: Student t, percentile and clustered bootstrap, paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.contract import finite


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return math.nan if not math.isfinite(t) or df <= 0 else beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for 0.5 <= p < 1, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def wilcoxon_p(d: np.ndarray) -> tuple[float, float]:
    """(W, p) of the signed-rank test: zeros dropped, mid-ranks; exact up to 25 untied pairs, else the normal approximation
    with tie correction."""
    d = d[np.isfinite(d) & (d != 0)]
    n = len(d)
    if n == 0:
        return math.nan, math.nan
    size, at, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    upto = np.cumsum(count)
    rank = (upto - (count - 1) / 2)[at]
    up, down = float(rank[d > 0].sum()), float(rank[d < 0].sum())
    w = min(up, down)
    if n <= 25 and len(size) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy() if r <= len(ways) - 1 else ways[r:]
        return w, min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return w, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def scene_sums(df: DataFrame, by: list[str], scene: str, value: str) -> DataFrame:
    """(by, scene, _sum, _n) of the finite values: all that the clustered statistics need."""
    return df.where(finite(F.col(value)) & F.col(scene).isNotNull()).groupBy(*by, scene).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))


def _resampled(sums: np.ndarray, counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Clustered bootstrap means; in blocks, so that memory stays bounded whatever the number of scenes."""
    rng, out, k = np.random.default_rng(seed), np.empty(draws), len(sums)
    block = max(1, 2_000_000 // k)
    for a in range(0, draws, block):
        idx = rng.integers(0, k, (min(block, draws - a), k))
        out[a : a + len(idx)] = sums[idx].sum(1) / counts[idx].sum(1)
    return out


def cluster_interval(df: DataFrame, by: list[str], scene: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """by, n, scenes, mean, lo, hi: the mean over rows and its 95 % interval from resampling whole scenes.

    Rows are first aggregated to one sum and count a scene; only these meet in the group's task, sorted by scene, so that the
    result doesn't depend on the input's order. Fewer than two scenes give null bounds.
    """
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] + ["n bigint", "scenes bigint", "mean double", "lo double", "hi double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(scene)
        s, c = pdf["_sum"].to_numpy(float), pdf["_n"].to_numpy(float)
        m = _resampled(s, c, draws, seed) if len(s) > 1 else None
        lo, hi = (None, None) if m is None else np.percentile(m, [2.5, 97.5])
        return pd.DataFrame([(*key, int(c.sum()), len(s), s.sum() / c.sum(), lo, hi)], columns=[*by, "n", "scenes", "mean", "lo", "hi"])

    return scene_sums(df, by, scene, value).groupBy(*by).applyInPandas(run, schema)


def compare_paired(df: DataFrame, by: list[str], scene: str, model: str, baseline: str, higher_is_better: bool = True, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Paired comparison by scene means: n, mean_delta, t interval, clustered bootstrap interval and p, paired t and Wilcoxon
    p-values, win_rate, and ``significant`` only if both tests say so at 5 %.

    df holds model and baseline values side by side; rows where either isn't finite are left out.
    """
    both = df.where(finite(F.col(model)) & finite(F.col(baseline)) & F.col(scene).isNotNull())
    sign = 1 if higher_is_better else -1
    per = both.groupBy(*by, scene).agg((sign * (F.avg(model) - F.avg(baseline))).alias("_d"), F.sum(sign * (F.col(model) - F.col(baseline))).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    names = ["scenes", "pairs", "mean_delta", "t_lo", "t_hi", "boot_lo", "boot_hi", "p_boot", "t_stat", "p_t", "w_stat", "p_w", "win_rate", "significant"]
    kinds = ["bigint", "bigint", *["double"] * 11, "boolean"]
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] + [f"{n} {k}" for n, k in zip(names, kinds)])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(scene)
        d, n = pdf["_d"].to_numpy(float), len(pdf)
        mean, sd = float(d.mean()), float(d.std(ddof=1)) if n > 1 else math.nan
        se = sd / math.sqrt(n)
        t = mean / se if se and math.isfinite(se) else math.nan
        q = t_quantile(0.975, n - 1) if n > 1 else math.nan
        m = _resampled(pdf["_sum"].to_numpy(float), pdf["_n"].to_numpy(float), draws, seed) if n > 1 else np.array([math.nan])
        p_boot = min(1.0, 2 * min(float((m <= 0).mean()), float((m >= 0).mean()))) if n > 1 else math.nan
        w, p_w = wilcoxon_p(d)
        p_t = t_two_sided(t, n - 1)
        lo, hi = np.percentile(m, [2.5, 97.5])
        return pd.DataFrame([(*key, n, int(pdf["_n"].sum()), mean, mean - q * se, mean + q * se, lo, hi, p_boot, t, p_t, w, p_w, float((d > 0).mean()), bool(p_t < 0.05 and p_w < 0.05))], columns=[*by, *names])

    return per.groupBy(*by).applyInPandas(run, schema)


def mean_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, lo, hi: the 95 % interval of Student's t, for few values (seeds); one value has null bounds."""
    s = df.where(finite(F.col(value))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("_se"))

    @F.pandas_udf("double")
    def factor(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(0.975, k - 1) if k > 1 else None for k in n.unique()}
        return n.map(known).astype(float)

    f = F.when(F.col("n") > 1, factor("n") * F.col("_se"))
    return s.select(*by, "n", "mean", (F.col("mean") - f).alias("lo"), (F.col("mean") + f).alias("hi"))


def bootstrap_interval(df: DataFrame, by: list[str], key: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean with each row for itself: the clustered one where every key is its own scene."""
    return cluster_interval(df, by, key, value, draws, seed)
