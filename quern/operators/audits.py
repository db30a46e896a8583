"""Diagnostic tables: concentration, clamps, bins, sweeps, profiles, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.contract import finite
from quern.operators.prefix import prefix_sums
from quern.operators.ranking import quantiles
from quern.plans.staging import at_most, broadcast_checked, stage


def concentration(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(top_share, n_top, carried): the part of the total that the highest share of the values carries; at least one value each.

    Values are aggregated to counts and accumulated from the top by partition prefixes.
    """
    ok = df.where(finite(F.col(value)))
    freq = ok.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.col(value) * F.col("_n"))
    run = stage(prefix_sums(freq, [], [F.col(value).desc()], ["_n", "_s"]), "from_top")
    tot = run.agg(F.max("cum__n").alias("_all"), F.sum("_s").alias("_total"))
    want = df.sparkSession.createDataFrame([(s,) for s in shares], "top_share double")
    asked = want.join(F.broadcast(tot)).withColumn("n_top", F.greatest(F.floor(F.col("top_share") * F.col("_all")), F.lit(1)).cast("bigint"))
    met = run.join(F.broadcast(asked)).where((F.col("cum__n") >= F.col("n_top")) & (F.col("cum__n") - F.col("_n") < F.col("n_top")))
    part = F.col("cum__s") - (F.col("cum__n") - F.col("n_top")) * F.col(value)
    return met.select("top_share", "n_top", F.try_divide(part, F.col("_total")).alias("carried"))


def clamp_tradeoff(df: DataFrame, value: str, caps: list[float]) -> DataFrame:
    """(cap, saturated, kept): the share of values above each cap and the part of their sum left after clamping at it; one scan."""
    ok = df.where(finite(F.col(value)))
    aggs = [a for i, c in enumerate(caps) for a in (F.avg((F.col(value) > c).cast("double")).alias(f"s{i}"), F.sum(F.least(F.col(value), F.lit(c))).alias(f"k{i}"))]
    one = ok.agg(F.sum(value).alias("_t"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cap"), F.col(f"s{i}").alias("saturated"), F.try_divide(F.col(f"k{i}"), F.col("_t")).alias("kept")) for i, c in enumerate(caps)])
    return one.select(F.inline(rows))


def binned_profile(df: DataFrame, by: str, value: str, edges: list[float], qs: dict[str, float]) -> DataFrame:
    """(bin_no, lo, hi, n, share, quantiles): half-open bins [lo, hi) of ``by``; rows outside all bins count in the share's whole."""
    ok = df.where(finite(F.col(by)) & finite(F.col(value)))
    chain = None
    for i in range(len(edges) - 1):
        inside = (F.col(by) >= edges[i]) & (F.col(by) < edges[i + 1])
        chain = F.when(inside, i) if chain is None else chain.when(inside, i)
    x = stage(ok.select(chain.alias("bin_no"), value), "binned")
    all_of = x.count()
    q = quantiles(x.where("bin_no is not null"), ["bin_no"], value, qs)
    at = lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin_no") + k)
    return q.select("bin_no", at(1).alias("lo"), at(2).alias("hi"), "n", (F.col("n") / F.lit(float(max(1, all_of)))).alias("share"), *qs)


def filter_sweep_quantiles(df: DataFrame, by: str, value: str, cutoffs: list[float], qs: dict[str, float]) -> DataFrame:
    """(cutoff, n, quantiles): for each cutoff on ``by`` the exact quantiles of the values of the rows at or above it."""
    ok = df.where(finite(F.col(by)) & finite(F.col(value)))
    met = F.array_compact(F.array(*[F.when(F.col(by) >= c, F.lit(float(c))) for c in cutoffs]))
    return quantiles(ok.select(F.explode(met).alias("cutoff"), F.col(value).cast("double").alias("_v0")), ["cutoff"], "_v0", qs)


def filter_sweep(df: DataFrame, by: str, value: str, cutoffs: list[float], limit: float) -> DataFrame:
    """(cutoff, kept, mean_value, exceed): for each cutoff on ``by`` the share of rows at or above it, their mean value and the
    share of them above limit; one scan."""
    ok = df.where(finite(F.col(by)) & finite(F.col(value)))
    keep = [F.col(by) >= c for c in cutoffs]
    aggs = [a for i, k in enumerate(keep) for a in (F.avg(k.cast("double")).alias(f"k{i}"), F.avg(F.when(k, F.col(value))).alias(f"m{i}"), F.avg(F.when(k, (F.col(value) > limit).cast("double"))).alias(f"e{i}"))]
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("kept"), F.col(f"m{i}").alias("mean_value"), F.col(f"e{i}").alias("exceed")) for i, c in enumerate(cutoffs)])
    return ok.agg(*aggs).select(F.inline(rows))


def column_profile(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """(column_name, rows, non_null, distincts, least, most, mode, mode_share, homogeneous, top_values) of each column, as text.

    Columns that df lacks are listed with null figures. The mode is the most frequent value, ties to the smallest text.
    """
    here = [c for c in columns if c in df.columns]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in here])).alias("x")).select("x.*")
    freq = stage(each.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    stats = freq.groupBy("column_name").agg(F.sum("n").alias("rows_in"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("v").alias("distincts"), F.min("v").alias("least"), F.max("v").alias("most"))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "v")
    best = freq.where("v is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    tops = best.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v", "n"))), lambda x: x["v"]).alias("top_values"), F.max(F.when(F.col("_r") == 1, F.col("v"))).alias("mode"), F.max("n").alias("_m"))
    out = stats.join(tops, "column_name", "left").withColumn("mode_share", F.try_divide("_m", "non_null")).withColumn("homogeneous", F.col("distincts") == 1).drop("_m")
    missing = [c for c in columns if c not in here]
    return out if not missing else out.unionByName(df.sparkSession.createDataFrame([(c,) for c in missing], "column_name string"), allowMissingColumns=True)


def two_way_contrast(df: DataFrame, flag: str, measures: list[str]) -> DataFrame:
    """(measure, flag, n, q25, q50, q75): exact quartiles of several measures on both sides of a flag."""
    long = df.where(F.col(flag).isNotNull()).select(flag, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select(flag, "x.*")
    return quantiles(long, ["measure", flag], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def contest(df: DataFrame, a: str, b: str, truth: str, subset: Column) -> DataFrame:
    """(part, n, a_wins, win_rate): rows where a is closer to the truth than b, over all rows and over the subset."""
    ok = df.where(finite(F.col(a)) & finite(F.col(b)) & finite(F.col(truth)))
    closer = F.abs(F.col(a) - F.col(truth)) < F.abs(F.col(b) - F.col(truth))
    parts = ok.select(closer.alias("w"), F.explode(F.array_compact(F.array(F.lit("all"), F.when(subset, "subset")))).alias("part"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("w").alias("a_wins")).withColumn("win_rate", F.col("a_wins") / F.col("n"))


def consistency_verdict(df: DataFrame, by: str, errors: list[str], tolerance: float, bar: float) -> DataFrame:
    """(by, n, good_share, consistent): share of rows all of whose relative errors are below the tolerance, against a bar."""
    good = F.lit(True)
    for e in errors:
        good = good & F.coalesce(F.col(e) < tolerance, F.lit(False))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(good.cast("double")).alias("good_share")).withColumn("consistent", F.col("good_share") >= bar)


def own_against_global(df: DataFrame, group: str, value: str, parameter: str) -> DataFrame:
    """One row: median of value times its group's median parameter, and times the global median one."""
    ok = stage(df.where(finite(F.col(value)) & finite(F.col(parameter)) & F.col(group).isNotNull()).select(group, value, parameter), "measures")
    own = quantiles(ok, [group], parameter, {"_own": 0.5}).drop("n")
    all_of = quantiles(ok, [], parameter, {"_all": 0.5}).drop("n")
    x = ok.join(broadcast_checked(own), group).join(F.broadcast(all_of))
    both = x.select(F.explode(F.array(F.struct(F.lit("own").alias("way"), (F.col(value) * F.col("_own")).alias("v")), F.struct(F.lit("global").alias("way"), (F.col(value) * F.col("_all")).alias("v")))).alias("y")).select("y.*")
    return quantiles(both, ["way"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def publishable(units: DataFrame, files: DataFrame, unit: str, kind: str, needs: list[str], target: str) -> DataFrame:
    """units with state: ok, missing_<kind> (the first needed file that is absent), or target_collision (another unit has its target)."""
    have = files.where(F.col(kind).isin(needs)).groupBy(unit).agg(F.collect_set(kind).alias("_have"))
    n = units.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    j = units.join(have, unit, "left").join(n, target, "left")
    state = None
    for k in needs:
        absent = ~F.coalesce(F.array_contains("_have", k), F.lit(False))
        state = F.when(absent, f"missing_{k}") if state is None else state.when(absent, f"missing_{k}")
    return j.select(*units.columns, state.when(F.col("_n") > 1, "target_collision").otherwise("ok").alias("state"))


def coverage(expected: DataFrame, done: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, expected, covered, missing): how much of a grid of keys is there."""
    d = done.select(*keys).distinct().withColumn("_d", F.lit(1))
    j = expected.select(*keys).distinct().join(d, keys, "left")
    out = j.groupBy(by).agg(F.count(F.lit(1)).alias("expected"), F.count("_d").alias("covered"))
    return out.withColumn("missing", F.col("expected") - F.col("covered"))


def staging_budget(groups: DataFrame, present: DataFrame, group: str, size: str, ceiling: int) -> DataFrame:
    """One row: bytes of the chosen groups already present and missing, and whether the missing ones fit under the ceiling."""
    p = present.select(group).distinct().withColumn("_p", F.lit(True))
    one = groups.join(p, group, "left").agg(F.coalesce(F.sum(F.when(F.col("_p"), F.col(size))), F.lit(0)).alias("present_size"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col(size))), F.lit(0)).alias("missing_size"))
    return one.withColumn("allowed", F.col("missing_size") <= ceiling)


def term_scales(df: DataFrame, terms: list[str], cap: float) -> DataFrame:
    """(term, n, p50, p99, saturated): distribution of each term's finite values and the share at or above the cap."""
    long = stage(df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("v")) for t in terms])).alias("x")).select("x.*").where(finite(F.col("v"))), "terms")
    sat = long.groupBy("term").agg(F.avg((F.col("v") >= cap).cast("double")).alias("saturated"))
    return quantiles(long, ["term"], "v", {"p50": 0.5, "p99": 0.99}).join(F.broadcast(sat), "term")


def pivot_report(df: DataFrame, row: str, column: str, values: list[str], measure: str, decimals: int = 2) -> DataFrame:
    """row by column table of means as text, 'n/d' where there is none."""
    p = df.groupBy(row).pivot(column, values).agg(F.avg(measure))
    return p.select(row, *[F.when(F.col(f"`{v}`").isNull(), "n/d").otherwise(F.format_string(f"%.{decimals}f", F.round(F.col(f"`{v}`"), decimals))).alias(v) for v in values])


def singles_pairs_triples(names: DataFrame, name: str) -> DataFrame:
    """(size, config): every single, pair and triple of a small set of names, sorted within; over 1 000 names are an error."""
    n = at_most(names.where(F.col(name).isNotNull()).select(F.col(name).alias("n")).distinct(), 1000, "names")
    a, b, c = (n.select(F.col("n").alias(k)) for k in "abc")
    two = a.join(b, F.col("b") > F.col("a"))
    three = two.join(c, F.col("c") > F.col("b"))
    pick = lambda x, k, *cs: x.select(F.lit(k).alias("size"), F.concat_ws("+", *cs).alias("config"))
    return pick(a, 1, "a").unionByName(pick(two, 2, "a", "b")).unionByName(pick(three, 3, "a", "b", "c"))
