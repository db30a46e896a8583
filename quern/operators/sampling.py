"""Splits, shards, samples and weights that depend on keys and hashes only, never on the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.keys import bucket, hash_order
from quern.operators.prefix import prefix_sums
from quern.operators.ranking import row_numbers
from quern.plans.staging import broadcast_checked, stage


def scene_side(scene: Column, val_fraction: float, salt: str) -> Column:
    """'val' for the scenes whose bucket of 10 000 is below round(10 000 f), else 'train'; null for a null scene."""
    if not 0 < val_fraction < 0.5:
        raise ValueError("val_fraction lies between 0 and 0.5")
    return F.when(scene.isNotNull(), F.when(bucket(salt, scene) < round(val_fraction * 10_000), "val").otherwise("train"))


def side_from_source(split: Column, names: dict[str, str], strict: bool = False) -> Column:
    """The side of a source's own split name, trimmed and in lower case; null where it is unknown or missing, or with strict an
    error when such a row is read."""
    spelled = F.lower(F.btrim(split))
    out = F.lit(None).cast("string")
    for spelling, side in names.items():
        out = F.when(spelled == spelling, side).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no side for split "), F.coalesce(split, F.lit("null")))).cast("string")) if strict else out


def pilot_groups(df: DataFrame, group: str, limit: int, seed: str) -> DataFrame:
    """All rows of whole groups, taken in hash order until at least ``limit`` rows are reached; null groups are left out."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hash_order(F.col(group), seed))
    run = prefix_sums(sizes, [], [F.col("_h").asc(), F.col(group).asc()], ["_n"])
    taken = run.where(F.col("cum__n") - F.col("_n") < limit).select(group)
    return df.join(broadcast_checked(taken), group, "left_semi")


def hash_sample(df: DataFrame, key: str, n: int, by: list[str] | None = None, seed: str | None = None) -> DataFrame:
    """The n rows (of each value of ``by``) whose key has the smallest SHA-256; rows of a null key are left out."""
    x = df.where(F.col(key).isNotNull()).withColumn("_h", hash_order(F.col(key), seed))
    if not by:
        return x.orderBy("_h", key).limit(n).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", key)
    return x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_h", "_rn")


def latin_hypercube(groups: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """n draws (draw_no, u, v) for each group: on either axis every one of n equal strata is hit once.

    The second axis's strata are permuted, and both are jittered, by SHA-256 of seed, group, axis and number: the same
    guarantees as a seeded generator's Latin hypercube, with other draws. Works row by row, without a shuffle.
    """
    h = lambda axis, i: F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"), F.lit(axis), i.cast("string")), 256)
    jitter = lambda axis, i: F.conv(F.substring(h(axis, i), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    order = F.transform(F.array_sort(F.transform(steps, lambda i: F.struct(h("p", i).alias("h"), i.alias("i")))), lambda s: s["i"])
    x = groups.where(F.col(group).isNotNull()).select(group, F.posexplode(order).alias("draw_no", "_p"))
    return x.select(group, "draw_no", ((F.col("draw_no") + jitter("u", F.col("draw_no"))) / n).alias("u"), ((F.col("_p") + jitter("v", F.col("draw_no"))) / n).alias("v"))


def interpolate(q: Column, v: Column, u: Column) -> Column:
    """Value at u of the piecewise linear function with knots q (ascending from 0 to 1) and v."""
    k = F.least(F.greatest(F.size(F.filter(q, lambda x: x <= u)), F.lit(1)), F.size(q) - 1)
    q0, q1, v0, v1 = q[k - 1], q[k], v[k - 1], v[k]
    return v0 + (v1 - v0) * F.coalesce(F.try_divide(u - q0, q1 - q0), F.lit(0.0))


def widened_draw(q: Column, v: Column, u: Column, widen: float = 0.25) -> tuple[Column, Column]:
    """(value, clamped): the quantile at u, its distance from the median stretched by 1 + widen, not below the least knot's
    value times 1 - widen."""
    mid = interpolate(q, v, F.lit(0.5))
    wide = mid + (1 + widen) * (interpolate(q, v, u) - mid)
    floor = F.array_min(v) * (1 - widen)
    return F.greatest(wide, floor), wide < floor


def route_weights(df: DataFrame, route: str, mass: dict[str, float], strict: bool = False) -> DataFrame:
    """df with weight = mass of its route / rows of its route; rows of a route without a mass have a null weight, or with strict
    are an error."""
    if strict and (unknown := df.where(~F.coalesce(F.col(route).isin(list(mass)), F.lit(False))).select(route).limit(1).collect()):
        raise ValueError(f"no weight for route {unknown[0][0]}")
    sizes = df.groupBy(route).agg(F.count(F.lit(1)).alias("_n"))
    masses = F.create_map(*[x for r, m in mass.items() for x in (F.lit(r), F.lit(float(m)))])
    return df.join(broadcast_checked(sizes), route).withColumn("weight", F.try_element_at(masses, F.col(route)) / F.col("_n")).drop("_n")


def replay_weights(df: DataFrame, route: str, synthetic: str, fraction: float, real: dict[str, float]) -> DataFrame:
    """Weights that give the synthetic route ``fraction`` of the mass and the real ones the rest, in the given proportions."""
    whole = sum(real.values())
    return route_weights(df, route, {synthetic: fraction, **{r: (1 - fraction) * w / whole for r, w in real.items()}})


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """(draw_no, key): n draws with replacement, each row as likely as its weight; rows without a positive weight are never drawn.

    Rows get intervals of the cumulative weight (prefix sums), draws a hash in (0, 1); both meet in an equi-join on equal
    slices of the total, about 64 draws in each.
    """
    rows = df.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"))
    run = stage(prefix_sums(rows, [], [F.col(key).asc()], ["_w"]), "cumulative")
    total = run.agg(F.sum("_w")).first()[0] or 0.0
    parts = max(1, n // 64)
    part = lambda x: F.least(F.floor(x / F.lit(total or 1.0) * parts), F.lit(parts - 1))
    spans = run.select(key, (F.col("cum__w") - F.col("_w")).alias("_lo"), F.col("cum__w").alias("_hi"))
    spans = spans.withColumn("_s", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi")))))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw_no"), (u * F.lit(total)).alias("_x"))
    met = draws.withColumn("_s", part(F.col("_x"))).join(spans, "_s").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
    return met.select("draw_no", key)


def stride_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows at positions floor(i * rows / n)."""
    rows = stage(df, "rows")
    total = rows.count()
    at = row_numbers(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_rn").drop("_all").withColumn("position", F.col("_rn") - 1).drop("_rn")
    i = F.ceil(F.col("position") * n / F.lit(float(max(1, total))))
    return at if n >= total else at.where((F.floor(i * total / F.lit(float(n))) == F.col("position")) & (i < n))
