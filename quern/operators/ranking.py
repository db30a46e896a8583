"""Positions and order statistics within groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.operators.skew import MOST, hot_keys
from quern.plans.staging import broadcast_checked, stage


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], number: str = "rn", count: str | None = None, hot_rows: int = 2_000_000) -> DataFrame:
    """df with the position from 1 of each row in its group, and the group's rows as ``count`` if that is named.

    Groups of fewer than hot_rows rows go through a window; hot ones (counted exactly) through range-sorted partitions and
    their prefix counts, so that none is sorted in one task; without keys all rows are one group, and hot. Null keys form a
    group. End the order in a unique column: equal rows get their numbers in an open order.
    """
    if not keys:
        rows = prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), [], order, ["__one"]).drop("__one").withColumnRenamed("cum___one", number)
        return rows.withColumn(count, F.lit(df.count())) if count else rows
    hot, many = hot_keys(df, keys, hot_rows)

    def plain(x: DataFrame) -> DataFrame:
        out = x.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
        return out.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if count else out

    if not many:
        return plain(df)
    named = [F.col(k).alias(f"__h_{k}") for k in keys]
    names, sizes = hot.select(*named), hot.select(*named, "__n")
    if many <= MOST:
        names, sizes = F.broadcast(names), F.broadcast(sizes)
    is_hot = [df[k].eqNullSafe(names[f"__h_{k}"]) for k in keys]
    cond = is_hot[0]
    for c in is_hot[1:]:
        cond = cond & c
    heavy = prefix_sums(df.join(names, cond, "left_semi").withColumn("__one", F.lit(1).cast("bigint")), keys, order, ["__one"])
    heavy = heavy.drop("__one").withColumnRenamed("cum___one", number)
    if count:
        on = heavy[keys[0]].eqNullSafe(sizes[f"__h_{keys[0]}"])
        for k in keys[1:]:
            on = on & heavy[k].eqNullSafe(sizes[f"__h_{k}"])
        heavy = heavy.join(sizes, on).withColumnRenamed("__n", count).drop(*[f"__h_{k}" for k in keys])
    light = plain(df.join(names, cond, "left_anti"))
    return light.unionByName(heavy.select(*light.columns))


def quantile_rows(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], kind: str = "linear") -> DataFrame:
    """(keys, n, name, q, quantile): exact quantiles of each group's finite values; n is their number.

    linear: between the two neighbours of (n-1)q; nearest: the value at (n-1)q rounded half to even; upper: the value at
    floor(n q), so that q = 0.5 is the upper median. Values are aggregated to counts, range-sorted, and counted by partition
    prefixes; the wanted positions then meet them in slices of their group. No group is held in one task. Null, NaN and
    infinite values don't count; a group without others isn't listed.
    """
    x = F.col(value)
    freq = stage(df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(*keys, x.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "frequencies")
    run = prefix_sums(freq, keys, [F.col("_v").asc()], ["_c"])
    sizes = stage(freq.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("_c").alias("n")), "sizes")
    n, q = F.col("n"), F.col("q")
    place = {"linear": (n - 1) * q, "nearest": F.bround((n - 1) * q, 0), "upper": F.least(F.floor(n * q), n - 1).cast("double")}[kind]
    wanted = F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("q")) for k, v in qs.items()]))
    asked = sizes.select("*", wanted).withColumn("_p", place).withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p")))))
    part = lambda at: F.floor(at * 1024 / n)
    asked = broadcast_checked(asked.withColumn("_slice", part(F.col("_at"))))
    small = broadcast_checked(sizes.select(*[F.col(f"_k_{k}").alias(f"_j_{k}") for k in keys], "n"))
    same = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    met = run.join(small, same or None).select(*keys, "_v", "_c", "cum__c", F.explode(F.sequence(part(F.col("cum__c") - F.col("_c")), part(F.col("cum__c") - 1))).alias("_s"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_s") == F.col("_slice"), F.col("_at") < F.col("cum__c"), F.col("_at") >= F.col("cum__c") - F.col("_c")]
    ends = met.join(asked, on).groupBy(*keys, "n", "name", "q", "_p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    got = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_p") - F.floor("_p"))
    return ends.select(*keys, "n", "name", "q", got.alias("quantile"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], kind: str = "linear") -> DataFrame:
    """keys, n and a column for each named quantile, see quantile_rows."""
    rows = quantile_rows(df, keys, value, qs, kind)
    found = rows.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("name", "quantile"))).alias("_m"))
    return found.select(*keys, "n", *[F.element_at("_m", F.lit(k)).alias(k) for k in qs])
