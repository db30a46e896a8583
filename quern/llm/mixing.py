"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import unit


def capped_cdf(mean: float, cap: int) -> list[float]:
    """P(X <= k), k = 0 .. cap-1, of X = min(Poisson, cap) with the given mean; mean 0 <= mean <= cap.

    The rate is found by bisection. At mean = cap every draw is cap: all zeros.
    """
    if mean <= 0:
        return [1.0] * cap
    if mean >= cap * (1 - 1e-12):
        return [0.0] * cap

    def cdf(rate: float) -> list[float]:
        p, total, out = math.exp(-rate), 0.0, []
        for k in range(cap):
            total += p
            out.append(total)
            p *= rate / (k + 1)
        return out

    low, high = 0.0, 1.0
    while sum(1 - c for c in cdf(high)) < mean and high < 700:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(1 - c for c in cdf(mid)) < mean else (low, mid)
    return cdf((low + high) / 2)


def mix_sources(docs: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, seed: str = "mix", seeds: int = 32) -> tuple[DataFrame, DataFrame]:
    """The mixed records (id, source, n_tokens, copy_no, in shuffled order) and a row for each target with its shares.

    docs: id, source, n_tokens, staged; targets: (source, weight, max_repeats), weights relative to their sum. A record is
    drawn min(Poisson, max_repeats) times, with the mean repetition rate at which its source gives its weight of ``total``
    tokens; the number comes from inverting the distribution at a hash of the seed and the id, so that it depends on nothing
    else. Of ``seeds`` seeds each source takes the one whose drawn tokens come nearest to its aim. Copies are exploded and
    sorted globally by a hash. Without ``total`` the largest is taken at which no source needs more than its max_repeats.

    Records of sources that aren't targets, with a null source or id, or with no tokens (empty and null texts) are left out.
    A target without records gives nothing, is reported with tokens 0, and doesn't bind the total; a null or non-positive
    weight or max_repeats counts as 0. Repeated ids are drawn alike.
    """
    spark = docs.sparkSession
    wanted = {s: (float(w), int(r)) for s, w, r in targets if s is not None and w and r and w > 0 and r > 0}
    weights = sum(w for w, _ in wanted.values()) or 1.0
    rows = docs.select("id", "source", "n_tokens").where(F.col("id").isNotNull() & (F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    have = {r["source"]: float(r["t"]) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    most = min((have[s] * wanted[s][1] * weights / wanted[s][0] for s in have), default=0.0)
    total = most if total is None else min(float(total), most)
    aim = {s: total * w / weights for s, (w, _) in wanted.items()}
    table = [(s, wanted[s][0] / weights, wanted[s][1], aim[s], capped_cdf(aim[s] / have[s], wanted[s][1])) for s in have]
    plan = F.broadcast(spark.createDataFrame(table, "source string, weight double, max_repeats int, aim double, cdf array<double>"))

    def count(n):
        return F.size(F.filter("cdf", lambda c: c <= unit_of(n)))

    def unit_of(n):
        return unit(seed, F.col("id").cast("string"), n)

    met = rows.join(plan, "source")
    tried = met.groupBy("source", "aim").agg(*[F.sum(count(F.lit(n)) * F.col("n_tokens")).alias(f"t{n}") for n in range(seeds)])
    off = F.array(*[F.struct(F.abs(F.col(f"t{n}") - F.col("aim")).alias("off"), F.lit(n).alias("n")) for n in range(seeds)])
    chosen = F.broadcast(spark.createDataFrame(tried.select("source", F.array_min(off)["n"].alias("seed_no")).collect(), "source string, seed_no int"))
    drawn = met.join(chosen, "source").withColumn("copies", count(F.col("seed_no"))).where("copies > 0")
    mixed = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("shuffle_key", F.xxhash64(F.lit(seed + "/order"), F.col("id").cast("string"), "copy_no"))
    mixed = mixed.select("id", "source", "n_tokens", "copy_no", "shuffle_key").orderBy("shuffle_key", "id", "copy_no")
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    all_of = spark.createDataFrame([(s, float(w or 0), int(r or 0), aim.get(s, 0.0), have.get(s, 0.0)) for s, w, r in targets], "source string, weight double, max_repeats int, aim_tokens double, source_tokens double")
    report = all_of.join(got, "source", "left").na.fill(0, ["tokens", "records", "copies", "most_copies"])
    return mixed, report.join(F.broadcast(got.agg(F.sum("tokens").alias("_all")))).withColumn("share", F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0))).drop("_all")
