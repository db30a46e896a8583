"""Records of evaluation splits that occur, the same or almost, among the training records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import salted_join
from quern.plans.staging import stage

CELLS, WIDE = 64, 8


def equal_pairs(evaluation: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """(eval_id, train_id) of rows with the same key, null matching nothing; both sides have id and key."""
    a = stage(evaluation.where(F.col(key).isNotNull()).select(F.col("id").alias("eval_id"), key), "keys")
    b = training.where(F.col(key).isNotNull()).select(F.col("id").alias("train_id"), key)
    return salted_join(a, b, [key], hot_rows=100_000).select("eval_id", "train_id")


def _features(thumb: Column) -> dict[str, Column]:
    """Sums over cells with weights +1 or -1, each of which changes by at most the summed cell difference.

    s0..s15: the 2x2 blocks; f0..f3: all cells, left against right, top against bottom, and one diagonal pair of quarters
    against the other.
    """
    cell = lambda y, x: thumb[y * WIDE + x].cast("int")
    blocks = {f"s{4 * by + bx}": cell(2 * by, 2 * bx) + cell(2 * by, 2 * bx + 1) + cell(2 * by + 1, 2 * bx) + cell(2 * by + 1, 2 * bx + 1) for by in range(4) for bx in range(4)}
    return blocks


_SIGNS = [[1] * 16, [1 if i % 4 < 2 else -1 for i in range(16)], [1 if i < 8 else -1 for i in range(16)], [1 if (i % 4 < 2) == (i < 8) else -1 for i in range(16)]]


def _signature(df: DataFrame) -> DataFrame:
    """(id, train, f0..f3, w0..w2) of rows with 64 cells of 0..255: the features, and the 16 block sums in ten bits each."""
    good = (F.size("thumb") == CELLS) & F.forall("thumb", lambda x: x.isNotNull() & x.between(0, 255))
    x = df.where(F.coalesce(good, F.lit(False))).select("id", "train", *[c.alias(n) for n, c in _features(F.col("thumb")).items()])
    total = lambda signs: reduce(lambda a, b: a + b, [F.col(f"s{i}") * s for i, s in enumerate(signs)])
    pack = lambda idx: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.col(f"s{i}").cast("bigint"), 10 * k) for k, i in enumerate(idx)])
    return x.select("id", "train", *[total(s).alias(f"f{k}") for k, s in enumerate(_SIGNS)], pack(range(6)).alias("w0"), pack(range(6, 12)).alias("w1"), pack(range(12, 16)).alias("w2"))


def near_pairs(evaluation: DataFrame, training: DataFrame, max_mean: float = 4.0, hot_rows: int = 20_000) -> DataFrame:
    """(eval_id, train_id) of rows whose thumbs (id, thumb: 8x8 grey values) differ by at most max_mean a cell on average.

    No pair is lost and none is approximate. With t the largest summed difference, any +1/-1 sum over the cells differs by at
    most t between the two thumbs of a pair. Four such sums give every row a cell of a grid 2t wide; a training row is placed
    in its own cell, an evaluation row in every cell that the box of half width t about it touches (at most 2 in each
    direction, so at most 16). Rows of one cell meet in an equi-join (hot cells are salted), whose condition keeps pairs
    with all four sums, and then the summed difference of sixteen 2x2 block sums, within t. The few pairs left are compared
    cell by cell.

    Thumbs that are null, not of 64 cells, or with a null cell or one outside 0..255 are in no pair. Repeated rows give a
    pair each. Empty tables give no pairs.
    """
    t = int(max_mean * CELLS)
    wide = 2 * t
    cell = [f"c{i}" for i in range(4)]
    both = evaluation.select("id", "thumb", F.lit(False).alias("train")).unionByName(training.select("id", "thumb", F.lit(True).alias("train")))
    signed = stage(_signature(both), "signatures")
    e, r = signed.where("not train").drop("train"), signed.where("train")
    here = [F.floor(F.col(f"f{i}") / wide).cast("int") for i in range(4)]
    r = r.select(*[c.alias(n) for c, n in zip(here, cell)], F.col("id").alias("train_id"), *[F.col(c).alias(f"t_{c}") for c in ("f0", "f1", "f2", "f3", "w0", "w1", "w2")])
    spans = [F.sequence(F.floor((F.col(f"f{i}") - t) / wide), F.floor((F.col(f"f{i}") + t) / wide)) for i in range(4)]
    box = lambda done: F.transform(spans[len(done)], lambda c: F.array(*done, c)) if len(done) == 3 else F.flatten(F.transform(spans[len(done)], lambda c: box([*done, c])))
    e = e.withColumn("_at", F.explode(box([])))
    e = stage(e.select(F.col("id").alias("eval_id"), "f0", "f1", "f2", "f3", "w0", "w1", "w2", *[F.col("_at")[i].cast("int").alias(n) for i, n in enumerate(cell)]), "probes")
    met = salted_join(e, r, cell, hot_rows=hot_rows)
    for i in range(4):
        met = met.where(F.abs(F.col(f"f{i}") - F.col(f"t_f{i}")) <= t)
    tens = lambda c, k: F.shiftright(F.col(c), 10 * k).bitwiseAND(F.lit(1023))
    apart = reduce(lambda a, b: a + b, [F.abs(tens(w, k) - tens(f"t_{w}", k)) for w, n in (("w0", 6), ("w1", 6), ("w2", 4)) for k in range(n)])
    few = met.where(apart <= t).select("eval_id", "train_id")
    few = stage(few, "few")
    a = few.join(evaluation.select(F.col("id").alias("eval_id"), F.col("thumb").alias("_a")), "eval_id")
    b = a.join(training.select(F.col("id").alias("train_id"), F.col("thumb").alias("_b")), "train_id")
    gap = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return b.where(gap <= F.lit(max_mean * CELLS)).select("eval_id", "train_id")


def content_chunks(cells: Column, step: int = 16, window: int = 4, mean: int = 8, least: int = 4) -> Column:
    """The chunks of an array of numbers as arrays, in order; null for null, for an empty array and for one with a null in it.

    Values are normalised to multiples of step. A rolling hash of the last ``window`` values marks, by content alone, one
    place in ``mean`` as a cut; a cut closer than ``least`` values to the one before is passed over. Joined together the
    chunks are the normalised array, so the same stretch gives the same chunks wherever it stands.
    """
    plain = F.transform(cells, lambda x: F.floor(x / F.lit(step)).cast("bigint"))
    weights = [17**k for k in range(window)]
    rolled = lambda a, i: reduce(lambda x, y: x + y, [F.element_at(a, (i - k).cast("int")) * w for k, w in enumerate(weights)])
    marked = lambda a: F.filter(F.sequence(F.lit(window), F.size(a) - 1), lambda i: F.pmod(rolled(a, i) * 2654435761, F.lit(1 << 32)) < (1 << 32) // mean)
    places = F.when(F.size(plain) > window, marked(plain)).otherwise(F.array().cast("array<int>"))
    cuts = F.aggregate(places, F.array(F.lit(0)), lambda seen, c: F.when(c - F.element_at(seen, -1) >= least, F.concat(seen, F.array(c))).otherwise(seen))
    ends = F.concat(F.slice(cuts, 2, F.size(cuts)), F.array(F.size(plain)))
    whole = cells.isNotNull() & (F.size(cells) > 0) & ~F.exists(cells, lambda x: x.isNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.zip_with(cuts, ends, lambda a, b: F.slice(plain, a + 1, b - a)))


def chunk_overlaps(evaluation: DataFrame, training: DataFrame, **cut: int) -> DataFrame:
    """(id, cells, shared, overlap) of each evaluation row: its values, those in chunks that some training row has too, and
    their share. Both sides: id, cells (array of numbers).

    Rows are normalised and cut by content (content_chunks, whose settings ``cut`` gives), the digests of the chunks are joined
    across the sides (distinct ones of training; a chunk in very many evaluation rows is salted), and the lengths of the
    chunks that meet are summed. The work grows with the chunks, not with the pairs. A digest is a 128-bit hash, so that
    different chunks practically never meet. Rows without values share nothing: cells 0, overlap null. Repeated ids give a
    row each time they come with the same values, summed; empty tables give an empty result, or nothing shared.
    """
    digest = lambda c: F.struct(F.xxhash64(c).alias("x"), F.xxhash64(F.lit("2"), c).alias("y"), F.size(c).alias("n"))
    each = lambda df: df.select("id", F.explode_outer(content_chunks(F.col("cells"), **cut)).alias("c")).select("id", digest(F.col("c")).alias("d"), F.coalesce(F.when(F.size("c") > 0, F.size("c")), F.lit(0)).alias("n"))
    own = stage(each(evaluation), "chunks")
    known = each(training).where("n > 0").select("d").distinct().withColumn("met", F.lit(True))
    met = salted_join(own, known, ["d"], "left")
    got = met.groupBy("id").agg(F.sum("n").alias("cells"), F.sum(F.when(F.col("met") & (F.col("n") > 0), F.col("n")).otherwise(0)).alias("shared"))
    return got.withColumn("overlap", F.try_divide("shared", "cells"))


def cross_split_counts(rows: DataFrame, key: str = "sha256", max_mean: float = 4.0) -> DataFrame:
    """(id, same, near) of each evaluation row with a partner: how many training rows have its key, and how many others
    near-same thumbs: the numbers of cross_split_pairs, without the pairs of equal keys themselves."""
    e, r = rows.where(F.col("side").isNotNull() & (F.col("side") != "train")), rows.where(F.col("side") == "train")
    near = near_pairs(e, r, max_mean).join(e.select(F.col("id").alias("eval_id"), F.col(key).alias("_a")), "eval_id").join(r.select(F.col("id").alias("train_id"), F.col(key).alias("_b")), "train_id")
    near = near.where("_a is null or _b is null or _a <> _b").select("eval_id", "train_id").distinct().groupBy(F.col("eval_id").alias("id")).agg(F.count(F.lit(1)).alias("near"))
    sizes = r.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("same"))
    same = salted_join(stage(e.where(F.col(key).isNotNull()).select("id", key), "keys"), sizes, [key]).select("id", "same")
    return same.join(near, "id", "full").select("id", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("near", F.lit(0)).alias("near"))


def cross_split_pairs(rows: DataFrame, key: str = "sha256", max_mean: float = 4.0) -> DataFrame:
    """(eval_id, train_id): the pairs of an evaluation and a training row with the same key or near-same thumbs.

    rows: id, side ('train' or an evaluation side; null is in no pair), key, thumb; staged. Each pair comes once.
    """
    e, r = rows.where(F.col("side").isNotNull() & (F.col("side") != "train")), rows.where(F.col("side") == "train")
    return equal_pairs(e, r, key).unionByName(near_pairs(e, r, max_mean)).distinct()
