"""References to records that are missing, deleted or not there yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.operators.skew import salted_join
from quern.plans.staging import broadcast_checked, stage

#: A block of the filter has LANES words of 64 bits, each key one bit in every word; with so many keys a block, about one absent
#: key in a hundred gets through.
LANES, KEYS_A_BLOCK, MAX_BITS = 4, 20, 1 << 27


def _bits(key: Column) -> dict[str, Column]:
    """The bit of key in each word of its block."""
    h = F.xxhash64(key)
    at = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return {f"__b{i}": F.call_function("shiftleft", F.lit(1).cast("bigint"), at(i)) for i in range(LANES)}


def _block(column: Column, key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column, key, F.lit("block")), F.lit(blocks).cast("bigint"))


def bloom_blocks(parents: DataFrame, blocks: int) -> DataFrame:
    """(__block, __b0 .. __b3): a blocked Bloom filter of the keys, a row for each block that holds any; parents: (column_name, key).

    It is built by an aggregate over the blocks, which is summed before the shuffle; no task holds more than its blocks.
    """
    rows = parents.select(_block(F.col("column_name"), F.col("key"), blocks).alias("__block"), *[c.alias(n) for n, c in _bits(F.col("key")).items()])
    return rows.groupBy("__block").agg(*[F.bit_or(f"__b{i}").alias(f"__b{i}") for i in range(LANES)])


def with_filter(refs: DataFrame, parents: DataFrame, keys: int, max_bits: int) -> DataFrame:
    """refs with ``__may``: whether the filter of the parents' keys lets (column_name, key) through; false is certain.

    A filter of at most max_bits bits is broadcast: its rows are counted by the number of keys beforehand. A larger one is met
    by its block in a shuffle join, in which blocks with very many references are salted.
    """
    blocks = max(1, -(-keys // KEYS_A_BLOCK))
    filter_rows = bloom_blocks(parents, blocks)
    asked = refs.withColumn("__block", _block(F.col("column_name"), F.col("key"), blocks))
    if blocks * 64 * LANES <= max_bits:
        met = asked.join(F.broadcast(filter_rows), "__block", "left")
    else:
        met = salted_join(stage(asked, "asked"), filter_rows, ["__block"], "left")
    held = reduce(lambda a, b: a & b, [F.col(n).bitwiseAND(c) == c for n, c in _bits(F.col("key")).items()])
    return met.select(*refs.columns, F.coalesce(held, F.lit(False)).alias("__may"))


def orphan_references(refs: DataFrame, parents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The references without a live target, with ref_state: missing, deleted or late.

    refs: id, column_name, key, at (any further columns are kept); parents: column_name, key, since, until, a row for each
    target row, live from since on, until until (null: for ever). A reference is live if some target row has since <= at and
    until null or > at. Else it is ``missing`` if no row has the key, ``deleted`` if some row has since <= at, else ``late``.

    A blocked Bloom filter of the parents' keys proves most missing references; its size follows the number of keys, and up
    to max_bits bits (about 10 million keys) it is broadcast, beyond that its blocks meet the references in a shuffle join.
    Only references that it lets through go into the exact join, with one row of facts for
    each key (its earliest start, its earliest start without end, its latest end); hot keys are salted. The facts decide all
    references but those whose key has ended rows only, some of which begin before and end after the moment: these are
    decided by running counts of started and ended rows, range-sorted by key and time.

    Null keys are no reference. A column of refs already named ref_state is replaced. A null moment is before everything: such a reference is late, or missing. A null since is
    never reached. Repeated rows on either side count as they are; empty tables give an empty result, or all missing.
    """
    held = stage(parents.where(F.col("key").isNotNull()).groupBy("column_name", "key").agg(
        F.min("since").alias("__first"),
        F.min(F.when(F.col("until").isNull(), F.col("since"))).alias("__open"),
        F.max(F.when(F.col("since").isNotNull(), F.col("until"))).alias("__end"),
    ), "facts")
    refs = refs.drop("ref_state")
    asked = refs.where(F.col("key").isNotNull())
    tested = stage(with_filter(asked, held, held.count(), max_bits), "tested")
    sure = tested.where(~F.col("__may")).withColumn("ref_state", F.lit("missing"))
    facts = salted_join(tested.where("__may"), held.withColumn("__has", F.lit(True)), ["column_name", "key"], "left")
    started, live = F.coalesce(F.col("__first") <= F.col("at"), F.lit(False)), F.coalesce(F.col("__open") <= F.col("at"), F.lit(False))
    open_end = F.coalesce(F.col("__end") > F.col("at"), F.lit(False))
    state = F.when(F.col("__has").isNull(), "missing").when(live, "live").when(~started, "late").when(~open_end, "deleted").otherwise("unsure")
    facts = stage(facts.withColumn("ref_state", state).drop("__first", "__open", "__end", "__has"), "states")
    unsure = facts.where("ref_state = 'unsure'")
    keys = broadcast_checked(unsure.select("column_name", "key").distinct())
    spans = parents.where("since is not null and until is not null and until > since").join(keys, ["column_name", "key"], "left_semi")
    tick = lambda df, when, kind, d: df.select("column_name", "key", F.col(when).alias("_t"), F.lit(kind).alias("_kind"), F.lit(d).cast("bigint").alias("_d"))
    points = unsure.select("column_name", "key", F.col("at").alias("_t"), F.lit(2).alias("_kind"), F.lit(0).cast("bigint").alias("_d")).distinct()
    swept = prefix_sums(tick(spans, "since", 0, 1).unionByName(tick(spans, "until", 1, -1)).unionByName(points), ["column_name", "key"], [F.col("_t").asc(), F.col("_kind").asc()], ["_d"])
    dead = swept.where("_kind = 2 and cum__d = 0").select("column_name", "key", F.col("_t").alias("at"))
    late = unsure.join(dead, ["column_name", "key", "at"], "left_semi").withColumn("ref_state", F.lit("deleted"))
    out = [*refs.columns, "ref_state"]
    return sure.select(*out).unionByName(facts.where("ref_state in ('missing', 'late', 'deleted')").select(*out)).unionByName(late.select(*out))
