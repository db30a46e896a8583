"""Selection of rows within groups: even caps, rank and cut, top k, duplicates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import quantiles, row_numbers
from quern.plans.staging import broadcast_checked, stage


def cap_even(df: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """At most ``keep`` rows of each group, evenly spaced in the given order, both ends included; keep = 1 gives the first.

    The positions are i(n-1)/(keep-1) rounded half to even. No group is dropped; smaller groups stay whole.
    """
    if keep < 1:
        raise ValueError("keep at least one row")
    x = row_numbers(df, group, order, "_rn", "_cnt")
    if keep == 1:
        return x.where(F.col("_rn") == 1).drop("_rn", "_cnt")
    at = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.bround(i * (F.col("_cnt") - 1) / F.lit(float(keep - 1)), 0).cast("bigint"))
    return x.where((F.col("_cnt") <= keep) | F.array_contains(at, F.col("_rn") - 1)).drop("_rn", "_cnt")


def rank_and_cut(df: DataFrame, source: str, score: str, tie: str, floor: float, quota: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows with rank, report): within each source the ``quota`` best rows with at least ``floor``, by falling score, then tie.

    The report has, for each source, its candidates, kept, the cut (lowest kept score) and the candidates' p05, p50, p95.
    Rows without a finite score are no candidates.
    """
    c = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = row_numbers(c.where(F.col(score) >= floor), [source], [F.col(score).desc(), F.col(tie).asc()], "rank_no")
    best = best.where(F.col("rank_no") <= quota)
    spread = quantiles(c, [source], score, {"p05": 0.05, "p50": 0.5, "p95": 0.95}).withColumnRenamed("n", "candidates")
    cut = best.groupBy(source).agg(F.count(F.lit(1)).alias("kept"), F.min(score).alias("cut_value"))
    return best, spread.join(cut, source, "left").na.fill(0, ["kept"])


def top_rows(df: DataFrame, score: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows of highest score, ties by the given columns; null and NaN scores are never among them."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.col(score).desc(), *tie).limit(k)


def top_groups(df: DataFrame, group: str, score: str, first: list[str], k: int) -> DataFrame:
    """All rows of the k groups whose first row, by the given columns, has the highest score; ties by group."""
    lead = df.groupBy(group).agg(F.min_by(score, F.struct(*first)).alias("_s"))
    best = lead.where(F.col("_s").isNotNull()).orderBy(F.col("_s").desc(), group).limit(k).select(group)
    return df.join(broadcast_checked(best), group, "left_semi")


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least values of the order's columns, with ``copies``, the rows of the key. Null keys are a
    key, a null comes before all values. One aggregate, summed before the shuffle: a key with any share of the rows is no
    harder than another."""
    return _one_of_each(df, key, F.min_by(F.struct(*df.columns), F.struct(*order)), F.count(F.lit(1)).alias("copies"))


def dedup_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest values of the order's columns; else as dedup_first."""
    return _one_of_each(df, key, F.max_by(F.struct(*df.columns), F.struct(*order)))


def _one_of_each(df: DataFrame, key: list[str], row: Column, *more: Column) -> DataFrame:
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    return df.groupBy(*named).agg(row.alias("_row"), *more).select("_row.*", *(["copies"] if more else []))


def dedup_reject(df: DataFrame, key: str, name: str, order: list[Column]) -> DataFrame:
    """The rows after the first of their key, with ``first_of``, the name of the first; nulls in key are no duplicates."""
    known = df.where(F.col(key).isNotNull())
    lead = known.groupBy(key).agg(F.min(F.struct(*order, F.col(name).alias("_name")))["_name"].alias("first_of"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return known.join(lead, key).where(F.col(name) != F.col("first_of"))


def ordinal_gaps(df: DataFrame, group: str, ordinal: str, start: int = 1) -> DataFrame:
    """Groups that miss ordinals between start and their largest: the group, its largest and the sorted missing ones."""
    g = df.where(F.col(group).isNotNull() & (F.col(ordinal) >= start)).groupBy(group).agg(F.max(ordinal).cast("int").alias("top"), F.collect_set(F.col(ordinal).cast("int")).alias("_have"))
    return g.select(group, "top", F.array_sort(F.array_except(F.sequence(F.lit(start), "top"), "_have")).alias("missing")).where(F.size("missing") > 0)


def largest_ratio_gaps(df: DataFrame, a: str, b: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows whose a and b differ most by abs(log(a/b)); rows where either isn't positive are left out."""
    x = df.where((F.col(a) > 0) & (F.col(b) > 0)).withColumn("log_gap", F.abs(F.log(F.col(a) / F.col(b))))
    return x.orderBy(F.round("log_gap", 9).desc(), *tie).limit(k)


def spread_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows at positions 0, s, 2s, ... with s = rows // n: spread over the table, not its head."""
    rows = stage(df, "rows")
    total = rows.count()
    step = max(1, total // max(1, n))
    at = row_numbers(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_rn").drop("_all")
    return at.where(((F.col("_rn") - 1) % step == 0) & ((F.col("_rn") - 1) / step < n)).withColumnRenamed("_rn", "position")


def limit_accepted(df: DataFrame, accepted: Column, order: list[str], n: int) -> DataFrame:
    """The first n accepted rows in order, with their number as ``accepted``: a limit that rows which are passed over don't use up.

    A null condition isn't accepted. End the order in a unique column.
    """
    ok = df.where(F.coalesce(accepted, F.lit(False)))
    best = ok.orderBy(*order).limit(n)
    return row_numbers(best.withColumn("_one", F.lit(0)), ["_one"], [F.col(c) for c in order], "accepted").drop("_one")


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def pair_by_stem(a: DataFrame, path_a: str, b: DataFrame, path_b: str) -> DataFrame:
    """Rows of a and b whose paths have the same stem, with ``stem``; null and empty paths pair with nothing."""
    x, y = a.withColumn("stem", stem(F.col(path_a))).where("stem <> ''"), b.withColumn("_stem", stem(F.col(path_b)))
    return x.join(y, F.col("stem") == F.col("_stem")).drop("_stem")
