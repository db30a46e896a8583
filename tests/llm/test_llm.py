"""The operators for training data against brute force, on small dirty tables."""

import itertools
import math
from bisect import bisect_left
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oracle import DATA, assert_same, connect
from quern.llm import chunking, cutoff, leaks, mixing, queries, splits, tokens, topn
from quern.plans.staging import stage

c = F.col
PATH = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.SQL:
        assert_same(con, df, queries.SQL[name])
    else:
        assert df.count() > 0


# 1: top N


def test_top_n_hot_and_cold_groups_agree(spark):
    random.seed(5)
    rows = [("hot" if i % 3 else random.choice(["a", "b", None]), random.choice([1.0, 2.0, 3.0, None]), random.choice(["x", None, "y"]), i, "clash", 7) for i in range(2000)]
    df = stage(spark.createDataFrame(rows, "g string, score double, sha string, id int, `__salt` string, rank_no int"))
    order = [c("score").desc(), c("sha").asc_nulls_last(), c("id").asc()]
    want = set()
    for g in ("hot", "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[3]))
        want |= {(r[3], k + 1) for k, r in enumerate(mine[:3])}
    for hot in (10, 100, 10**9):
        got = topn.top_n_per_group(df, "g", order, 3, hot_rows=hot)
        assert {(r["id"], r["rank_no"]) for r in got.collect()} == want
    assert topn.top_n_per_group(df.limit(0), "g", order, 3).count() == 0
    twice = spark.createDataFrame([("g", 1.0)] * 9, "g string, score double")
    assert topn.top_n_per_group(twice, "g", [c("score").desc()], 3, hot_rows=2).count() == 3


# 2: splits


def _union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(root):
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    random.seed(9)
    edges = {
        "path": [(f"n{i:03}", f"n{i + 1:03}") for i in random.sample(range(60), 60)],
        "star": [("hub", f"n{i:03}") for i in range(80)] + [(None, "x"), ("x", None), ("y", "y")],
        "random": [(f"n{random.randint(0, 60):03}", f"n{random.randint(0, 60):03}") for _ in range(45)] * 2,
        "empty": [],
    }[shape]
    got = defaultdict(set)
    for r in splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect():
        got[r["root"]].add(r["node"])
        assert r["root"] == min(r["root"], r["node"])
    assert sorted(map(sorted, got.values())) == [x for x in _union_find([e for e in edges if None not in e]) if len(x) > 1]


def test_group_split_keeps_ties_and_shares(spark):
    random.seed(2)
    rows = [(f"s{random.randint(0, 400)}" if i % 4 else "big", f"t{random.randint(0, 5000)}" if i % 3 else None, random.choice(["p", "q", None])) for i in range(3000)]
    rows += [(None, "t1", "p")]
    nodes, tied = splits.group_split(stage(spark.createDataFrame(rows, "node string, tie string, label string")), [("train", 0.7), ("val", 0.2), ("test", 0.1), ("none", 0.0)])
    side = {r["node"]: (r["component"], r["side"]) for r in nodes.collect()}
    assert set(side) == {r[0] for r in rows if r[0]}
    by_tie = defaultdict(set)
    for n, t, _ in rows:
        if n and t:
            by_tie[t].add(n)
    for group in by_tie.values():
        assert len({side[n] for n in group}) == 1
    assert {r["node"] for r in tied.collect()} == {n for g in by_tie.values() if len(g) > 1 for n in g}
    assert "none" not in {s for _, s in side.values()}


def test_annealing_reaches_the_shares(spark):
    random.seed(4)
    rows = [(f"k{i}", random.choice("abc"), random.randint(1, 9)) for i in range(3000)] + [("huge", "a", 3000)]
    comp = stage(spark.createDataFrame(rows, "component string, label string, n int"))
    got = {r["component"]: r["side"] for r in splits.split_components(comp, [("train", 0.8), ("val", 0.1), ("test", 0.1)]).collect()}
    total, size = sum(r[2] for r in rows), Counter()
    for k, _, n in rows:
        size[got[k]] += n
    assert len(got) == len(rows) and abs(size["train"] / total - 0.8) < 0.01 and abs(size["val"] / total - 0.1) < 0.01
    assert splits.split_components(comp.limit(0), [("train", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        splits.split_components(comp, [("train", 0.0)])


def test_every_label_is_balanced(spark):
    """Sixty labels: each near the shares if it counts for itself; on average, if most are summed in pools (those of one pool
    are balanced together; a hash alone leaves them 0.045 away on average)."""
    random.seed(6)
    rows = [(f"k{i}", f"l{i % 60}" if i % 61 else None, random.randint(1, 5)) for i in range(6000)]
    comp = stage(spark.createDataFrame(rows, "component string, label string, n int"))
    for own in (5, 1000):
        got = {r["component"]: r["side"] for r in splits.split_components(comp, [("train", 0.5), ("val", 0.5)], own_labels=own, pools=200).collect()}
        total, train = Counter(), Counter()
        for k, label, n in rows:
            total[label] += n
            train[label] += n * (got[k] == "train")
        off = [abs(train[x] / total[x] - 0.5) for x in total]
        assert sum(off) / len(off) < 0.025 and (own == 5 or max(off) < 0.05)


# 4: leaks


def _python_chunks(cells, step=16, window=4, mean=8, least=4):
    q, cuts = [x // step for x in cells], [0]
    for i in range(window, len(q)):
        h = sum(q[i - 1 - k] * 17**k for k in range(window)) * 2654435761 % (1 << 32)
        if h < (1 << 32) // mean and i - cuts[-1] >= least:
            cuts.append(i)
    return [tuple(q[a:b]) for a, b in zip(cuts, [*cuts[1:], len(q)])]


def test_chunk_overlaps_against_brute_force(spark):
    random.seed(12)
    pool = [[random.randint(0, 255) for _ in range(40)] for _ in range(6)]
    make = lambda: [random.randint(0, 255) for _ in range(random.randint(0, 9))] + random.choice(pool) + [7] * random.randint(0, 30)
    odd = [None, [], [1, None, 3], [5], [1, 2, 3, 4]]
    a, b = [(i, x) for i, x in enumerate([make() for _ in range(150)] + odd)], [(i, x) for i, x in enumerate([make() for _ in range(20)] + odd[:4])]
    known = {c for _, x in b if x and None not in x for c in _python_chunks(x)}
    df = lambda rows: spark.createDataFrame(rows, "id int, cells array<int>")
    got = {r["id"]: r for r in leaks.chunk_overlaps(df(a), df(b)).collect()}
    assert set(got) == {i for i, _ in a}
    for i, x in a:
        chunks = _python_chunks(x) if x and None not in x else []
        assert sum(map(len, chunks), 0) == got[i]["cells"] and got[i]["shared"] == sum(len(c) for c in chunks if c in known)
        assert (got[i]["overlap"] is None) == (not chunks)
    assert sum(0 < r["shared"] < r["cells"] for r in got.values()) > 50
    assert leaks.chunk_overlaps(df([]), df(b)).count() == 0 and {r["shared"] for r in leaks.chunk_overlaps(df(a), df([])).collect()} == {0}


def test_counts_are_those_of_the_pairs(spark):
    random.seed(15)
    rows = [(i, random.choice(["train", "train", "val", None]), random.choice([None, "hot", f"h{i % 9}"]), [random.choice([0, 3]) + 40 * (i % 5)] * 64) for i in range(120)]
    df = stage(spark.createDataFrame(rows, "id int, side string, sha256 string, thumb array<int>"))
    want = Counter(r["eval_id"] for r in leaks.cross_split_pairs(df).collect())
    got = {r["id"]: (r["same"], r["near"]) for r in leaks.cross_split_counts(df).collect()}
    key, train = {r[0]: r[2] for r in rows}, Counter(r[2] for r in rows if r[1] == "train" and r[2])
    assert {k: sum(v) for k, v in got.items()} == dict(want) and all(v[0] == train[key[k]] for k, v in got.items())


def test_near_pairs_lose_nothing(spark):
    random.seed(8)
    rows, i = [], 0
    for _ in range(60):
        base = [random.randint(0, 255) for _ in range(64)]
        for kind in range(4):
            t = list(base)
            if kind == 1:  # every cell by four: the whole budget, all in one direction
                t = [min(255, x + 4) for x in base]
            if kind == 2:  # one cell takes the whole budget
                t[random.randrange(64)] = random.randint(0, 255)
            if kind == 3:  # just beyond
                t = [x + 5 if x < 128 else x - 5 for x in base]
            rows.append((i, random.choice(["train", "val", "test", None]), random.choice([None, f"h{i % 40}"]), t))
            i += 1
    rows += [(i, "val", None, None), (i + 1, "train", None, [1] * 63), (i + 2, "train", None, [1] * 63 + [None]), (i + 3, "val", None, [1] * 63 + [300]), (i + 4, "train", "h1", None)]
    want = set()
    for a, b in itertools.permutations(rows, 2):
        if a[1] in ("val", "test") and b[1] == "train":
            good = all(x[3] is not None and len(x[3]) == 64 and all(v is not None and 0 <= v <= 255 for v in x[3]) for x in (a, b))
            if (a[2] is not None and a[2] == b[2]) or (good and sum(abs(x - y) for x, y in zip(a[3], b[3])) <= 256):
                want.add((a[0], b[0]))
    df = stage(spark.createDataFrame(rows, "id int, side string, sha256 string, thumb array<int>"))
    assert {tuple(r) for r in leaks.cross_split_pairs(df).collect()} == want
    e, t = df.where("side <> 'train'"), df.where("side = 'train'")
    cold = sorted(map(tuple, leaks.near_pairs(e, t).collect()))
    assert sorted(map(tuple, leaks.near_pairs(e, t, hot_rows=1).collect())) == cold
    assert leaks.cross_split_pairs(df.limit(0)).count() == 0


# 6: cutoffs


def test_cutoffs_with_ties_nulls_and_clashing_columns(spark):
    random.seed(6)
    rows = [(random.choice(["a", "b", None, "other"]), random.choice([1.0, 2.0, 2.0, 5.0, math.nan, None, 0.0]), i, -1.0, "x") for i in range(500)]
    df = stage(spark.createDataFrame(rows, "source string, score double, id int, cutoff double, keep_fraction string"))
    targets = spark.createDataFrame([("a", 0.3), ("a", 0.25), ("b", 1.0), ("ghost", 0.5), (None, 0.5), ("other", None)], "source string, keep_fraction double")
    cut = stage(cutoff.fraction_cutoffs(df, targets))
    got = {r["source"]: r for r in cut.collect()}
    assert set(got) == {"a", "b"}
    kept = Counter(r["source"] for r in cutoff.keep_above(df, cut).collect())
    for s, f in (("a", 0.3), ("b", 1.0)):
        x = sorted((r[1] for r in rows if r[0] == s and r[1] is not None and not math.isnan(r[1])), reverse=True)
        k = math.ceil(f * len(x))
        assert (got[s]["n"], got[s]["k"], got[s]["cutoff"]) == (len(x), k, x[k - 1])
        assert got[s]["kept"] == kept[s] == sum(v >= x[k - 1] for v in x)
    assert cutoff.fraction_cutoffs(df.limit(0), targets).count() == 0


# 8: token ids

TEXTS = [None, "", " ", "\n\n", "a", "don't can't 'tis !'s '' ''s", "日本語のテキスト。改行\r\n　あり", "x" * 5000, "^" * 3000, "a b" * 4000, "<|endoftext|> tail", "naïve café    x  y   z", "123abc!?'re'd", "é" * 900, " \x1c\x85 a", "𝔘𝔫𝔦 👩‍👩‍👧", "tab\tand \t mixed\n ", "z " * 20000]


def test_forced_boundaries_are_certain():
    random.seed(7)
    encode = tokens.encoder(PATH).encode_ordinary
    pool = "ab'sre tdl1 2!?.\n\t　 éß日本。'"
    for t in [t for t in TEXTS if t] + ["".join(random.choice(pool) for _ in range(random.randint(2, 80))) for _ in range(1500)]:
        for size in (1, 7, 50):
            parts = tokens.fragments(t, PATH, size)
            assert "".join(parts) == t
            assert [i for p in parts for i in encode(p)] == encode(t), t
    assert len(tokens.fragments("word " * 1000, PATH, 16)) > 200


def test_next_cut_is_the_first_certain_one():
    for t in [t for t in TEXTS if t]:
        cuts = [*tokens.certain_cuts(t, PATH).tolist(), len(t)]
        for at in range(1, min(len(t), 600)):
            assert tokens.next_cut(t, at, PATH) == cuts[bisect_left(cuts, at)]


def test_encode_texts_whole_rows_and_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[-1], "again", None)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, `__sha` string, ids string")
    got = tokens.encode_texts(df, size=1000).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == (other.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])
    assert tokens.encode_texts(df.limit(0)).count() == 0


# 9: mixing


def test_capped_poisson_means():
    for cap in (1, 2, 5):
        for mean in (0.0, 0.01, 0.5 * cap, 0.99 * cap, float(cap)):
            cdf = mixing.capped_cdf(mean, cap)
            assert len(cdf) == cap and abs(sum(1 - p for p in cdf) - mean) < 1e-6


def test_mix_reaches_weights_within_caps(spark):
    random.seed(11)
    rows = [(i, random.choice(["a"] * 8 + ["b", "c", None, "untold"]), random.choice([0, 5, 20, 20, 300]), 9.0) for i in range(6000)]
    docs = stage(spark.createDataFrame(rows, "id int, source string, n_tokens int, weight double"))
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("empty", 0.1, 5), ("bad", None, 3), ("off", 0.2, 0)]
    mixed, report = mixing.mix_sources(docs, targets)
    got = mixed.collect()
    assert {r["source"] for r in got} == {"a", "b", "c"} and all(r["n_tokens"] > 0 for r in got)
    caps, uses, size = {"a": 1, "b": 3, "c": 2}, Counter((r["id"], r["source"]) for r in got), Counter()
    assert all(n <= caps[s] for (_, s), n in uses.items())
    assert len({(r["id"], r["copy_no"]) for r in got}) == len(got)
    for r in got:
        size[r["source"]] += r["n_tokens"]
    total = sum(size.values())
    assert all(abs(size[s] / total - w) < 0.02 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    rep = {r["source"]: r for r in report.collect()}
    assert len(rep) == 6 and rep["empty"]["tokens"] == 0 and all(rep[s]["tokens"] == size[s] for s in size)
    assert sorted(r["id"] for r in mixing.mix_sources(docs, targets)[0].collect()) == sorted(r["id"] for r in got)
    assert mixing.mix_sources(docs.limit(0), targets)[0].count() == 0


# 10: pieces


def test_pieces_cover_overlap_and_prefer_boundaries(spark):
    limits = [(1, 40, 8), (2, 16, 0), (3, 100, 30)]
    rows = list(enumerate(TEXTS)) + [(90, "One two three. " * 60), (91, "para one is here.\n\npara two is here too.\n\n" * 20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, ids string")
    got = defaultdict(list)
    for r in chunking.split_long(df, limits).collect():
        got[r["limit_id"], r["doc_id"]].append(r)
    encode = tokens.encoder(PATH).encode_ordinary
    for lid, most, over in limits:
        for i, t in rows:
            ids = encode(t or "")
            pieces = sorted(got.get((lid, i), []), key=lambda r: r["piece_no"])
            assert bool(pieces) == (len(ids) > most)
            whole = []
            for k, p in enumerate(pieces):
                assert p["piece_no"] == k and len(p["ids"]) == p["n_tokens"] <= most
                assert k == 0 or list(p["ids"][:over]) == list(pieces[k - 1]["ids"])[len(pieces[k - 1]["ids"]) - over :]
                whole += list(p["ids"][over if k else 0 :])
            assert not pieces or whole == ids
    assert {p["cut"] for p in got[1, 90][:-1]} == {"sentence"}
    assert {p["cut"] for p in got[1, 91][:-1]} == {"paragraph"}
    with pytest.raises(ValueError):
        chunking.split_long(df, [(1, 10, 10)])
