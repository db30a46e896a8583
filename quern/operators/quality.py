"""Column-level profile of loads of a table, from range-sorted values: nulls, distincts, ranges, quantiles, changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.plans.staging import broadcast_checked, stage


def unpivot(df: DataFrame, load: str, columns: dict[str, str]) -> DataFrame:
    """(load, column_name, is_text, value, text): a row for each value of the given columns (source column -> name), numbers as
    double in value, strings in text; arrays of numbers give a row for each element, null and empty arrays none."""

    def one(c: str, name: str) -> DataFrame:
        kind = df.schema[c].dataType.simpleString()
        text = kind == "string"
        value = F.lit(None).cast("double") if text else F.explode(F.col(c).cast("array<double>")) if kind.startswith("array") else F.col(c).cast("double")
        return df.select(F.col(load).alias("load"), F.lit(name).alias("column_name"), F.lit(text).alias("is_text"), value.alias("value"), (F.col(c) if text else F.lit(None).cast("string")).alias("text"))

    return reduce(DataFrame.unionByName, [one(c, n) for c, n in columns.items()])


def frequencies(values: DataFrame) -> DataFrame:
    """Staged unpivoted values with their number n, with NaN as one value and null as one; load null is dropped."""
    return stage(values.where(F.col("load").isNotNull()).groupBy(*values.columns).agg(F.count(F.lit(1)).alias("n")), "frequencies")


def profile(freq: DataFrame, previous: DataFrame, in_range: Callable[[Column, Column], Column], pattern: str = ".*", quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """A row for each load and column: rows, nulls, distincts (NaN is one value), least and most (NaN left out), outside (numbers
    that are NaN, infinite or not in range), breaches (strings that pattern doesn't match as a whole), q_<percent> quantiles
    of the values in range, exact, linear between neighbours, and ks, the exact Kolmogorov-Smirnov distance of the load's
    finite values from those of the load before it.

    freq comes from frequencies(); in_range(column_name, value) says which finite values are allowed; previous: (load,
    prev_load), any load may be the previous of several. Each load's counts, and beside them those of the load before it, are
    range-sorted once by column, load and value over all partitions; prefix counts of the partitions give the cumulative
    curves of both, and the number of distinct values. A quantile is read off where the count in range passes its rank, the
    distance is the largest gap between the two curves' shares. No load or column is ever in one task.

    outside, least, most and quantiles are null for a column of strings, breaches for one of numbers; quantiles are null
    without a value in range, ks without finite values on both sides. The empty string is a value. Empty tables give an
    empty result.
    """
    v, text = F.col("value"), F.col("is_text")
    links = previous.where("load is not null and prev_load is not null").select("load", "prev_load").distinct()
    finite = F.coalesce(~text & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    zero = F.lit(0).cast("bigint")
    own = freq.select("load", "column_name", "is_text", "value", "text", F.col("n").alias("a"), zero.alias("b"))
    old = freq.where(finite).withColumnRenamed("load", "prev_load").join(broadcast_checked(links), "prev_load").select("load", "column_name", "is_text", "value", "text", zero.alias("a"), F.col("n").alias("b"))
    fine = finite & F.coalesce(in_range(F.col("column_name"), v), F.lit(False))
    known = F.coalesce("text", v.cast("string")).isNotNull()
    both = own.unionByName(old).withColumns({"fine": F.when(fine, F.col("a")).otherwise(zero), "good": F.when(finite, F.col("a")).otherwise(zero), "one": F.when((F.col("a") > 0) & known, 1).otherwise(0).cast("bigint")})
    run = prefix_sums(both, ["column_name", "load"], [v.asc(), F.col("text").asc()], ["fine", "good", "b", "one"], peers=True)
    rank = lambda q: (F.col("all_fine") - 1) * F.lit(q)
    reach = lambda r: F.min(F.when((F.col("fine") > 0) & (F.col("cum_fine") > r), v))
    ends = [e for i, q in enumerate(quantiles) for e in (reach(F.floor(rank(q))).alias(f"_lo{i}"), reach(F.ceil(rank(q))).alias(f"_hi{i}"))]
    mine, number = F.col("a") > 0, F.when(~F.isnan(v), v)
    bad = text & F.col("text").isNotNull() & ~F.col("text").rlike(rf"\A(?:{pattern})\z")
    gap = F.abs(F.try_divide("cum_good", "all_good") - F.try_divide("cum_b", "all_b"))
    of = run.groupBy("load", "column_name", "is_text", "all_fine", F.col("all_one").alias("distincts")).agg(
        F.sum("a").alias("rows"),
        F.sum(F.when(known, 0).otherwise(F.col("a"))).alias("nulls"),
        F.sum(F.when(known & (F.col("fine") == 0), F.col("a")).otherwise(0)).alias("outside"),
        F.sum(F.when(bad, F.col("a")).otherwise(0)).alias("breaches"),
        F.min(F.when(mine, number)).alias("least"),
        F.max(F.when(mine, number)).alias("most"),
        F.max(F.when(finite, gap)).alias("ks"),
        *ends,
    )
    part = lambda i, q: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rank(q) - F.floor(rank(q)))
    found = [part(i, q).alias(f"q_{q * 100:g}".replace(".", "_")) for i, q in enumerate(quantiles)]
    only = lambda c, cond: F.when(cond, F.col(c)).alias(c)
    return of.where("rows > 0").select("load", "column_name", "rows", "nulls", "distincts", only("outside", ~text), only("breaches", text), "least", "most", *found, "ks")
