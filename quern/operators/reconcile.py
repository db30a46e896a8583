"""Reconciliation of keyed tables: leaks, missing and orphaned references, conflicts, content comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import at_most


def leak_audit(rows: DataFrame, split: DataFrame, scene: str = "scene_id", side: str = "split") -> DataFrame:
    """(problem, scene, n): the five ways a split by scene can leak, from the recorded sides of rows and the split table.

    both_sides: a scene recorded on several sides; no_scene: rows without a scene (scene null); no_side: rows without a side;
    not_in_split: a scene the split doesn't have; disagrees: a scene recorded on another side than the split says.
    split: (scene, side), one row a scene.
    """
    per = rows.groupBy(scene, side).agg(F.count(F.lit(1)).alias("n"))
    known = split.select(F.col(scene).alias("_s"), F.col(side).alias("_want")).withColumn("_in", F.lit(True))
    by = per.groupBy(scene).agg(F.sum("n").alias("n"), F.countDistinct(side).alias("sides"), F.sum(F.when(F.col(side).isNull(), F.col("n")).otherwise(0)).alias("bare"), F.collect_set(side).alias("seen"))
    met = by.join(known, F.col(scene) == F.col("_s"), "left")
    has = F.col(scene).isNotNull()
    tests = {
        "both_sides": (has & (F.col("sides") > 1), F.col("n")),
        "no_scene": (~has, F.col("n")),
        "no_side": (F.col("bare") > 0, F.col("bare")),
        "not_in_split": (has & F.col("_in").isNull(), F.col("n")),
        "disagrees": (has & F.col("_in") & (F.size(F.array_remove("seen", F.col("_want"))) > 0), F.col("n")),
    }
    hits = F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(k).alias("problem"), n.alias("n"))) for k, (t, n) in tests.items()])))
    return met.select(F.col(scene).alias("scene"), hits.alias("x")).select("x.problem", "scene", "x.n")


def prefer_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a and b by key, a's value first where both have a column, b's where a's is null or a has no row."""
    both = [c for c in a.columns if c != key and c in b.columns]
    bb = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_b_{c}") for c in b.columns if c != key])
    j = a.join(bb, a[key] == F.col("_key"), "full")
    pick = [F.coalesce(F.col(key), F.col("_key")).alias(key)]
    pick += [F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) if c in both else F.col(c) for c in a.columns if c != key]
    return j.select(*pick, *[F.col(f"_b_{c}").alias(c) for c in b.columns if c != key and c not in both])


def compare_listings(a: DataFrame, b: DataFrame, key: str, size: str) -> DataFrame:
    """(key, state): missing in b, extra in b, size_differs or same; keys are unique on either side, null keys are left out."""
    x = a.where(F.col(key).isNotNull()).select(F.col(key).alias("_ka"), F.col(size).alias("_sa"))
    y = b.where(F.col(key).isNotNull()).select(F.col(key).alias("_kb"), F.col(size).alias("_sb"))
    state = F.when(F.col("_kb").isNull(), "missing").when(F.col("_ka").isNull(), "extra").when(~F.col("_sa").eqNullSafe(F.col("_sb")), "size_differs").otherwise("same")
    return x.join(y, F.col("_ka") == F.col("_kb"), "full").select(F.coalesce("_ka", "_kb").alias(key), state.alias("state"))


def absent_by_content(local: DataFrame, remote: DataFrame, digest: str) -> DataFrame:
    """Rows of local whose digest no row of remote has, whatever their names; a null digest is never present."""
    return local.join(remote.where(F.col(digest).isNotNull()).select(digest).distinct(), digest, "left_anti")


def classify_local(local: DataFrame, remote: DataFrame, path: str, size: str, digest: str) -> DataFrame:
    """local with state: absent, no_remote_digest, size_differs, digest_differs or identical, in this order of tests."""
    r = remote.select(F.col(path).alias("_p"), F.col(size).alias("_s"), F.col(digest).alias("_d"))
    state = (
        F.when(F.col("_p").isNull(), "absent")
        .when(F.col("_d").isNull(), "no_remote_digest")
        .when(~F.col(size).eqNullSafe(F.col("_s")), "size_differs")
        .when(~F.col(digest).eqNullSafe(F.col("_d")), "digest_differs")
        .otherwise("identical")
    )
    return local.join(r, F.col(path) == F.col("_p"), "left").select(*[local[c] for c in local.columns], state.alias("state"))


def merge_scalars(rows: DataFrame, scalars: DataFrame, route: str, needs: str, key: str) -> DataFrame:
    """Rows of the route ``needs`` that have a match in scalars, with its columns, and all rows of other routes, with nulls."""
    need = rows.where(F.col(route) == needs).join(scalars, key)
    return need.unionByName(rows.where(F.coalesce(F.col(route) != needs, F.lit(True))), allowMissingColumns=True)


def last_complete(table: DataFrame, key: str, required: list[str], order: Column) -> DataFrame:
    """A lookup table: rows with no required field null, and of repeated keys the last one."""
    whole = table.where(" and ".join(f"`{x}` is not null" for x in [key, *required]))  # not dropna(), which drops NaN as well
    return whole.groupBy(key).agg(F.max_by(F.struct(*[c for c in whole.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def two_level_lookup(rows: DataFrame, table: DataFrame, first: str, second: str, value: str, found: str = "value") -> DataFrame:
    """rows with the table's value of their first key or else of their second, and where it came from (null: nowhere).

    table: (key, value), one row a key.
    """
    t = table.where(F.col("key").isNotNull())
    a = t.select(F.col("key").alias("_k1"), F.col(value).alias("_v1"))
    b = t.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    j = rows.join(a, F.col(first) == F.col("_k1"), "left").join(b, F.col(second) == F.col("_k2"), "left")
    origin = F.when(F.col("_v1").isNotNull(), first).when(F.col("_v2").isNotNull(), second)
    return j.select(*rows.columns, F.coalesce("_v1", "_v2").alias(found), origin.alias("found_by"))


def spread_over(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group, with the sorted groups; nulls are left out."""
    x = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("groups"))
    return x.where(F.size("groups") > 1)


def overlap_shares(rows: DataFrame, key: str, probes: DataFrame, bench: str) -> DataFrame:
    """For each bench of probes (bench, key), and for their union as '*': keys and rows of rows whose key it has, with shares."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    p = probes.where(F.col(key).isNotNull()).select(bench, key).distinct()
    each = p.unionByName(p.select(F.lit("*").alias(bench), key).distinct())
    total = per.agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_r"))
    hit = each.join(per, key).groupBy(bench).agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows_hit"))
    return hit.join(F.broadcast(total)).select(bench, "keys", "rows_hit", (F.col("keys") / F.col("_k")).alias("key_share"), (F.col("rows_hit") / F.col("_r")).alias("row_share"))


def grid_minus_done(a: DataFrame, b: DataFrame, done: DataFrame) -> DataFrame:
    """Every pair of a row of a and one of b that done doesn't have; over 10 000 rows of b are an error."""
    return a.join(at_most(b, 10_000, "rows of the grid's second side")).join(done, [c for c in done.columns], "left_anti")


def reconcile_counts(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Rows of each value of ``by`` on either side, 0 where it has none, and whether they agree."""
    x = a.groupBy(F.col(by).alias("_a")).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(F.col(by).alias("_b")).agg(F.count(F.lit(1)).alias("n_b"))
    j = x.join(y, F.col("_a").eqNullSafe(F.col("_b")), "full")
    j = j.select(F.coalesce("_a", "_b").alias(by), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return j.withColumn("agrees", F.col("n_a") == F.col("n_b"))


def beyond_requested(df: DataFrame, column: str, requested: list[str]) -> DataFrame:
    """Distinct non-null values of column that aren't among the requested ones."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(requested)).select(column).distinct()


def union_with_conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): the union of two assignments; conflict where a key has several values (the least is given)."""
    u = a.select(key, value).unionByName(b.select(key, value)).where(F.col(key).isNotNull())
    return u.groupBy(key).agg(F.min(value).alias(value), (F.countDistinct(value) > 1).alias("conflict"))


def keyed_diff(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(key, state, delta): added in b, removed from it, changed (beyond the tolerance) or equal, and b's value minus a's."""
    x = a.select(F.col(key).alias("_ka"), F.col(value).alias("_va"))
    y = b.select(F.col(key).alias("_kb"), F.col(value).alias("_vb"))
    delta = F.col("_vb") - F.col("_va")
    same = F.col("_va").eqNullSafe(F.col("_vb")) | F.coalesce(F.abs(delta) <= tolerance, F.lit(False))
    state = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(same, "equal").otherwise("changed")
    return x.join(y, F.col("_ka") == F.col("_kb"), "full").select(F.coalesce("_ka", "_kb").alias(key), state.alias("state"), delta.alias("delta"))


def joined_or_reason(left: DataFrame, right: DataFrame, key: str, reason: str) -> DataFrame:
    """left join of right (unique by key) with ``status``, 'ok' or the reason for rows without a match: no row is lost."""
    r = right.withColumn("_ok", F.lit(True))
    return left.join(r, key, "left").withColumn("status", F.when(F.col("_ok"), "ok").otherwise(reason)).drop("_ok")
