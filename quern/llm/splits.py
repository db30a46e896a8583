"""Splits in which related records never part: components of ties, then a search for the split of the components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import unit
from quern.operators.skew import salted_join
from quern.plans.staging import broadcast_checked, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), strings; root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round hangs a node's larger neighbours on its smallest one, then its
    smaller ones, until nothing changes; the number of edges never grows. Each round is staged. A node with very many edges
    is cut by salts in the joins. Edges with a null end and loops join nothing and are dropped, repeated edges count once.
    """
    e = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = stage(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "sym")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, down, ["u"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        e = stage(small.distinct(), "small")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def tie_components(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a tie with another node; nodes: (node, tie), any number of rows of each.

    Rows with a null node or tie bind nothing. Nodes without a partner aren't listed.
    """
    pairs = stage(nodes.where("node is not null and tie is not null").select("node", "tie").distinct(), "ties")
    shared = pairs.groupBy("tie").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("tie", "a")
    return stage(connected_components(salted_join(pairs, shared, ["tie"]).select("a", F.col("node").alias("b"))), "roots")


def _anneal(sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, want: np.ndarray, steps: int, seed: int) -> tuple[float, np.ndarray]:
    """Best (cost, side of each component) of one chain. labels: components x labels counts; want: sides x (1 + labels) rows wanted.

    A move takes a component to another side, every other one exchanges two components of different sides. The cost is the
    summed absolute deviation of the sides' sizes plus half that of their label counts, as shares of all rows.
    """
    rng = np.random.default_rng(seed)
    weight = np.concatenate([[1.0], np.full(labels.shape[1], 0.5)])
    parts = np.concatenate([sizes[:, None], labels], axis=1).astype(float)
    side = start.copy()
    have = np.zeros_like(want)
    np.add.at(have, side, parts)
    total = max(1.0, float(sizes.sum()))
    gap = have - want
    by_side = np.abs(gap) @ weight
    cost = by_side.sum() / total
    best, kept = cost, side.copy()
    n, k = len(sizes), len(want)
    if n == 0 or k < 2:
        return best, kept
    heat = 0.05 * cost + 1e-9
    one, two, shift, luck = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(1, k, steps), rng.random(steps)
    for t in range(steps):
        i, a = one[t], side[one[t]]
        j = two[t] if t % 2 and side[two[t]] != a else -1
        b = side[j] if j >= 0 else (a + shift[t]) % k
        delta = parts[i] - parts[j] if j >= 0 else parts[i]
        ga, gb = gap[a] - delta, gap[b] + delta
        ca, cb = np.abs(ga) @ weight, np.abs(gb) @ weight
        new = cost + (ca + cb - by_side[a] - by_side[b]) / total
        if new <= cost or luck[t] < np.exp((cost - new) / (heat * (1 - t / steps) + 1e-12)):
            gap[a], gap[b], by_side[a], by_side[b], cost = ga, gb, ca, cb, new
            side[i] = b
            if j >= 0:
                side[j] = a
            if cost < best - 1e-15:
                best, kept = cost, side.copy()
    return best, kept


def _search(components: DataFrame, want_share: np.ndarray, chains: int, moves: int, seed: int) -> DataFrame:
    """(component, side_no) by the best of the chains of each block; components: component, n, labels (numbers) and counts of
    these, block, start.

    want_share: sides x (1 + labels), the rows each side should still get, of all blocks together; a block takes its part in
    proportion to its own rows, and looks at the labels it has.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", ignore_index=True)
        sizes = pdf["n"].to_numpy(float)
        row = np.repeat(np.arange(len(pdf)), pdf["labels"].map(len))
        known, at = np.unique(np.concatenate(pdf["labels"].tolist()).astype(int), return_inverse=True)
        labels = np.zeros((len(pdf), len(known)))
        np.add.at(labels, (row, at), np.concatenate(pdf["counts"].tolist()))
        own = np.concatenate([[sizes.sum()], labels.sum(0)])
        open_share = want_share[:, np.concatenate([[0], known + 1])]
        want = open_share / np.maximum(open_share.sum(0), 1e-9) * own
        cost, side = _anneal(sizes, labels, pdf["start"].to_numpy(int), want, max(6000, moves * len(pdf)), seed * 1009 + int(pdf["chain"][0]))
        return pd.DataFrame({"block": [pdf["block"][0]], "chain": [pdf["chain"][0]], "cost": [cost], "names": [pdf["component"].tolist()], "sides": [side.tolist()]})

    many = components.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    tried = many.groupBy("block", "chain").applyInPandas(run, "block long, chain int, cost double, names array<string>, sides array<int>")
    best = tried.groupBy("block").agg(F.min_by(F.struct("names", "sides"), F.struct("cost", "chain")).alias("b"))
    return best.select(F.inline(F.arrays_zip("b.names", "b.sides"))).toDF("component", "side_no")


def split_components(components: DataFrame, targets: list[tuple[str, float]], seed: int = 17, chains: int = 2, moves: int = 6, block: int = 2048, own_labels: int = 1000, pools: int = 64) -> DataFrame:
    """(component, side): a side for every component, near the wanted shares of rows in total and within each label.

    components: (component string, label string, n), a row for each component and label, staged. Component swap search: every
    component starts at the side its hash gives; then simulated annealing moves or exchanges whole components to lower the
    deviation of the sides' sizes and label counts; several chains run side by side, of ``moves`` steps for each component,
    and the best is kept. Components with at least a thousandth of all rows (so at most a thousand) are searched first,
    together; the others in blocks of about ``block`` components, each aiming at its part of what the large ones left open.
    No task holds more than a block.

    Every label counts in the cost, a null one too: the own_labels most frequent ones each for itself, the others summed in
    ``pools`` groups by a hash of their name, so that what a task or the driver holds of labels is bounded. Shares are taken
    relative to their sum; a side of share 0 or null gets nothing. A component too large for every side goes where the
    deviation is least. An empty table gives an empty result; targets without a positive share are an error.
    """
    names = [s for s, f in targets if f is not None and f > 0]
    share = np.array([f for _, f in targets if f is not None and f > 0], float)
    if not names:
        raise ValueError("no side has a positive share")
    share = share / share.sum()
    spark, label = components.sparkSession, F.coalesce("label", F.lit("\0"))
    top = components.groupBy(label.alias("l")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").limit(own_labels).collect()
    known = F.broadcast(spark.createDataFrame([(r["l"], i) for i, r in enumerate(top)], "l string, no int"))
    number = F.coalesce("no", (F.lit(len(top)) + F.pmod(F.xxhash64("l"), F.lit(pools))).cast("int")).alias("no")
    rows = components.select("component", label.alias("l"), "n").join(known, "l", "left").select("component", number, "n")
    per_label = rows.groupBy("component", "no").agg(F.sum("n").cast("double").alias("n"))
    u = unit(f"side{seed}", F.col("component"))
    start = sum([(u >= float(c)).cast("int") for c in np.cumsum(share)[:-1]], F.lit(0))
    of = per_label.groupBy("component").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("no", "n"))).alias("x"))
    whole = stage(of.select("component", "n", F.col("x.no").alias("labels"), F.col("x.n").alias("counts"), start.alias("start")), "components")
    counts = np.zeros(1 + len(top) + pools)
    each = whole.select(F.explode(F.arrays_zip("labels", "counts")).alias("x")).groupBy("x.labels").agg(F.sum("x.counts").alias("n"))
    for r in each.collect():
        counts[1 + r["labels"]] = r["n"]
    counts[0] = counts[1:].sum()
    blocks = max(1, -(-whole.count() // block))
    want = share[:, None] * counts[None, :]
    large = max(2.0, counts[0] / 1000)
    big = whole.where(F.col("n") >= large).withColumn("block", F.lit(0).cast("bigint"))
    rest = whole.where(F.col("n") < large).withColumn("block", F.pmod(F.xxhash64("component", F.lit("block")), F.lit(blocks)))
    first = stage(_search(big, want, chains * 2, 2 * moves, seed), "large")
    took = first.join(big, "component").select("side_no", F.explode(F.arrays_zip("labels", "counts")).alias("x")).groupBy("side_no", "x.labels").agg(F.sum("x.counts").alias("n"))
    for r in took.collect():
        want[r["side_no"], [0, 1 + r["labels"]]] -= r["n"]
    want = np.maximum(want, 0)
    out = first.unionByName(_search(rest, want, chains, moves, seed))
    return out.select("component", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("side_no") + 1).alias("side"))


def group_split(records: DataFrame, targets: list[tuple[str, float]], **search: int) -> tuple[DataFrame, DataFrame]:
    """A side for every node, such that nodes joined by ties never part.

    records: (node string, tie string or null, label string or null), a row for each record; a record's node is what can't
    be divided (its scene, or itself). Gives two tables: (node, component, side) of all nodes, and of the nodes tied to
    another one only. Records with a null node have no side.
    """
    rows = records.where(F.col("node").isNotNull())
    sizes = stage(rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")), "nodes")
    roots = tie_components(rows)
    of = stage(sizes.join(broadcast_checked(roots), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root"), "sizes")
    sides = stage(split_components(of.groupBy("component", "label").agg(F.sum("n").alias("n")), targets, **search), "sides")
    tied = roots.withColumnRenamed("root", "component").join(sides, "component")
    return of.select("node", "component").distinct().join(sides, "component").select("node", "component", "side"), tied.select("node", "component", "side")
