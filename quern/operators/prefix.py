"""Running sums over a range-sorted table, without one task per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import broadcast_checked, stage


def null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: list[str], partitions: int | None = None, peers: bool = False) -> DataFrame:
    """df with ``cum_<c>`` for each c of sums: the sum of c over the rows of the same keys up to this row, in the given order;
    and ``all_<c>`` with peers, the sum over all rows of the keys.

    The table is range-sorted by keys and order, so that a key with any share of the rows spreads over many partitions; each
    partition sums for itself, and the (keys, partition) totals before it are added. Those totals are at most one row for
    each key plus one for each partition. Rows of equal keys and order never straddle a partition; among them the order is
    open, so give a total order where that matters, or peers: each then counts all of them. Null keys form a key of their
    own; null values count as 0. An empty table gives an empty result.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    ends = [F.coalesce(F.sum(f"__t_{c}").over(whole), F.lit(0)).alias(f"all_{c}") for c in sums] if peers else []
    totals = stage(totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums], *ends), "totals")
    here = Window.partitionBy(*keys, "__part").orderBy(*order)
    here = here.rangeBetween(Window.unboundedPreceding, 0) if peers else here.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"cum_{c}": F.coalesce(F.sum(c).over(here), F.lit(0)) for c in sums})
    both = local.join(broadcast_checked(totals), null_safe(local, totals, [*keys, "__part"]))
    out = [*[local[c] for c in df.columns], *[(local[f"cum_{c}"] + totals[f"__b_{c}"]).alias(f"cum_{c}") for c in sums]]
    return both.select(*out, *([totals[f"all_{c}"] for c in sums] if peers else []))
