"""Score cutoffs that keep a wanted fraction of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.plans.staging import broadcast_checked, stage


def fraction_cutoffs(df: DataFrame, targets: DataFrame, source: str = "source", score: str = "score", fraction: str = "keep_fraction") -> DataFrame:
    """For each source of targets with scored rows: n rows, k = ceil(fraction * n), the k-th highest score as cutoff, and how
    many rows have at least that score (kept; more than k where scores tie).

    Rows are first aggregated to (source, score, count); the cumulative counts from the highest score down come from range-
    sorted partitions and the totals before each, so that a source with most of the rows is never in one task. The cutoff is
    the score whose cumulative count is the first to reach k: of the cutoffs that keep at least the wanted fraction, the one
    closest to it.

    Rows with a null source, or a null or NaN score, don't count. A source named twice in targets takes its largest
    fraction; a null fraction gives no row. A fraction <= 0 keeps the rows of the highest score, one >= 1 all. Empty tables
    give an empty result.
    """
    wanted = targets.where(F.col(source).isNotNull() & F.col(fraction).isNotNull()).groupBy(source).agg(F.max(fraction).alias(fraction))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).join(broadcast_checked(wanted).select(source), source, "left_semi")
    freq = rows.groupBy(source, score).agg(F.count(F.lit(1)).alias("_n"))
    run = prefix_sums(freq, [source], [F.col(score).desc()], ["_n"])
    run = stage(run, "cumulative")
    size = run.groupBy(source).agg(F.max("cum__n").alias("n"))
    size = size.join(wanted, source).withColumn("k", F.greatest(F.least(F.ceil(F.col(fraction) * F.col("n")), F.col("n")), F.lit(1)).cast("bigint"))
    hit = run.join(size, source).where(F.col("cum__n") >= F.col("k"))
    return hit.groupBy(source, fraction, "n", "k").agg(F.max(score).alias("cutoff"), F.min("cum__n").alias("kept"))


def keep_above(df: DataFrame, cutoffs: DataFrame, source: str = "source", score: str = "score") -> DataFrame:
    """The rows of df at or above their source's cutoff; rows without a score or a cutoff are not kept."""
    c = broadcast_checked(cutoffs.select(source, F.col("cutoff").alias("__cutoff")))
    return df.join(c, source).where(~F.isnan(score) & (F.col(score) >= F.col("__cutoff"))).select(*df.columns)
