"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.plans.staging import free_name, stage

#: Keys of a table that may be broadcast; more of them meet their rows in a shuffle join.
MOST = 100_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, int]:
    """(keys and their counts as ``__n``, how many) of the keys with at least hot_rows rows of df, counted exactly.

    They are rows / hot_rows at most. Up to MOST of them come as a local table to broadcast, more as a staged one without a
    hint; the number is then MOST + 1.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows)
    got = counts.limit(MOST + 1).collect()
    if len(got) > MOST:
        return stage(counts, "hot"), len(got)
    fields = [StructField(k, df.schema[k].dataType) for k in keys]
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in got], StructType([*fields, StructField("__n", LongType())]))), len(got)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = 200_000) -> DataFrame:
    """Equi-join of left and right on keys, where single keys of left may be hot.

    Keys are counted exactly. A key of at least hot_rows rows is cut into one salt for each hot_rows of its rows, whatever the
    size of the table, and the rows of right under that key are repeated for each salt; all other rows are joined as they are.
    ``how`` is inner or left. Null keys match nothing. left should be a staged table, since it is read twice. The result has
    the keys once, then the other columns of left and of right.
    """
    hot, many = hot_keys(left.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, hot_rows)
    if not many:
        return left.join(right, keys, how)
    salt, salts_of = free_name("_salt", left, right), free_name("_salts", left, right)
    salts = hot.select(*keys, F.greatest(F.lit(2), F.ceil(F.col("__n") / hot_rows)).cast("int").alias(salts_of))
    salts = F.broadcast(salts) if many <= MOST else salts
    one = F.coalesce(F.col(salts_of), F.lit(1))
    spread = [F.col(f.name) for f in left.schema if "map<" not in f.dataType.simpleString()]  # not rand(): a task that runs again must salt alike
    a = left.join(salts, keys, "left").withColumn(salt, F.when(one == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), one)).cast("int")).drop(salts_of)
    b = right.join(salts, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1))).drop(salts_of)
    return a.join(b, [*keys, salt], how).drop(salt)
