"""Rules on records: every violation, the first failing rule of a cascade, closed vocabularies, typed extraction."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import broadcast_checked


def finite(c: Column) -> Column:
    """Whether c is a number that is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names its missing columns; decided when the plan is made."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds, in order; a null condition doesn't hold. The first one: element 0."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


@dataclass(frozen=True)
class Rule:
    """A reason to drop a row; column names what it needs: if that is absent the rule is off, or an error if mandatory."""

    reason: str
    fails: Column
    column: str | None = None
    mandatory: bool = False


def drop_cascade(df: DataFrame, rules: list[Rule], reason: str = "drop_reason") -> DataFrame:
    """df with the reason of the first rule that fails, null for rows that stay; a null condition doesn't fail."""
    chain = None
    for r in rules:
        if r.column is not None and r.column not in df.columns:
            if r.mandatory:
                raise ValueError(f"rule {r.reason} needs column {r.column}")
            warnings.warn(f"rule {r.reason} is off: no column {r.column}", stacklevel=2)
            continue
        chain = F.when(r.fails, r.reason) if chain is None else chain.when(r.fails, r.reason)
    return df.withColumn(reason, F.lit(None).cast("string") if chain is None else chain)


def histogram(df: DataFrame, by: str, n: str = "n", share: str = "share") -> DataFrame:
    """Rows of each value of ``by`` that isn't null, and their share of all rows, those with null included."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    total = counts.agg(F.sum(n).alias("_t"))
    return counts.where(F.col(by).isNotNull()).join(F.broadcast(total)).select(by, n, (F.col(n) / F.col("_t")).alias(share))


def keep_calibrated(df: DataFrame, source: str, score: str, least: float, k: str) -> DataFrame:
    """Rows with score >= least and k > 0; a source without any positive score passes whole. NaN is no measurement.

    A source that loses all its rows is absent here; emptied_sources() names it.
    """
    positive_score = (F.col(score) > 0) & ~F.isnan(score)
    measured = df.groupBy(source).agg(F.coalesce(F.bool_or(positive_score), F.lit(False)).alias("_measured"))
    met = df.join(broadcast_checked(measured), source)
    good = F.coalesce((F.col(score) >= least) & ~F.isnan(score) & (F.col(k) > 0), F.lit(False))
    return met.where(~F.col("_measured") | good).select(*df.columns)


def emptied_sources(df: DataFrame, source: str, score: str, least: float, k: str) -> DataFrame:
    """(source, rows) of the measured sources of which keep_calibrated keeps nothing: an error for most callers."""
    good = F.coalesce((F.col(score) >= least) & ~F.isnan(score) & (F.col(k) > 0), F.lit(False))
    measured = (F.col(score) > 0) & ~F.isnan(score)
    per = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("_kept"), F.count_if(measured).alias("_measured"))
    return per.where("_measured > 0 and _kept = 0").select(source, "rows")


def positive(c: Column | str, slug: str, zero: bool = False) -> tuple[Column, Column]:
    """(value, error): c as a finite number > 0 (>= 0 with zero), or null and the slug. c may be text."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    ok = finite(x) & ((x >= 0) if zero else (x > 0))
    return F.when(ok, x), F.when(~ok, F.lit(slug))


def unknown_values(df: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """Values of column outside the vocabulary, with their rows; null isn't a value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vocabulary.select(F.col(word).alias(column)).distinct(), column, "left_anti")
