"""Top N rows within every group, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.skew import MOST, hot_keys
from quern.plans.staging import free_name


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank_no", hot_rows: int = 10_000) -> DataFrame:
    """The first n rows of each group in the given order, with their rank from 1.

    Groups are counted exactly. A group of at least hot_rows rows is hot, whatever the size of the table: its rows are
    range-sorted over all partitions, each partition is one salt, the first n of every (group, salt) are kept, and these few
    are ranked again. All other groups are ranked by an ordinary window. Both results are united.

    Rows of a null group belong to no group. Ties are settled by the order alone, so end it in a unique column: rows equal
    in all of it (repeated rows) come out in an open order, though always n of them. Nulls sort as the order says. A group of
    fewer than n rows comes out whole, an empty table empty. A column of df already
    named like rank is replaced. df is read three times, so it should be a table or staged.
    """
    df = df.drop(rank)
    salt = free_name("_salt", df)
    rows = df.where(F.col(group).isNotNull())
    hot, many = hot_keys(rows, [group], hot_rows)
    hot = F.broadcast(hot.select(group)) if many <= MOST else hot.select(group)
    light = rows.join(hot, group, "left_anti")
    heavy = rows.join(hot, group, "left_semi").repartitionByRange(F.col(group), *order).withColumn(salt, F.spark_partition_id())

    def first(x: DataFrame, *keys: str) -> DataFrame:
        return x.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)

    heavy = first(first(heavy, group, salt).drop(rank), group).drop(salt)
    return first(light, group).select(*df.columns, rank).unionByName(heavy.select(*df.columns, rank))
