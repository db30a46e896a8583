"""Operators on small tables made by hand: ties, nulls, repeats, skew, empties, broken inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import keys, numeric, text
from quern.operators import arrays, audits, contract, gates, inference, kernels, prefix, quality, ranking, reconcile, sampling, select, skew, stats
from quern.plans.staging import stage

c = F.col


def test_prefix_sums_with_hot_key_nulls_and_ties(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else random.choice(["a", None]), random.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r["i"]: r["cum_v"] for r in prefix.prefix_sums(df, ["k"], [c("v").asc(), c("i").asc()], ["v"]).collect()}
    for k in ("hot", "a", None):
        total = 0
        for _, v, i in sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2])):
            total += v
            assert got[i] == total
    assert prefix.prefix_sums(df.limit(0), ["k"], [c("v").asc()], ["v"]).count() == 0


def test_salted_join_equals_join(spark):
    left = stage(spark.createDataFrame([("x" if i < 900 else f"k{i % 7}" if i % 5 else None, i) for i in range(1500)], "k string, i int"))
    right = spark.createDataFrame([("x", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "i", "w").collect()))
        assert sorted(map(str, skew.salted_join(left, right, ["k"], how, hot_rows=100).select("k", "i", "w").collect())) == want


def test_row_numbers_agree_for_hot_groups(spark):
    df = stage(spark.createDataFrame([("h" if i % 4 else None, (i * 37) % 101, i) for i in range(2000)], "g string, v int, i int"))
    order = [c("v").desc(), c("i").asc()]
    a = ranking.row_numbers(df, ["g"], order, "rn", "n", hot_rows=10**9).select("i", "rn", "n")
    b = ranking.row_numbers(df, ["g"], order, "rn", "n", hot_rows=100).select("i", "rn", "n")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("kind", ["linear", "nearest", "upper"])
def test_quantiles(spark, kind):
    x = [3.0, 1.0, 1.0, 7.0, 5.0, 9.0, 2.0, 2.0, math.nan, math.inf, None]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", None)], "g string, v double")
    qs = {"q1": 0.25, "q2": 0.5, "q3": 0.9}
    got = {r["g"]: r for r in ranking.quantiles(df, ["g"], "v", qs, kind).collect()}
    s = sorted(v for v in x if v is not None and math.isfinite(v))
    want = {"linear": lambda q: float(np.quantile(s, q)), "nearest": lambda q: s[round(q * (len(s) - 1))], "upper": lambda q: s[min(int(len(s) * q), len(s) - 1)]}[kind]
    assert set(got) == {"a"} and got["a"]["n"] == 8
    assert all(abs(got["a"][k] - want(q)) < 1e-12 for k, q in qs.items())


def test_even_cap_follows_half_even_rounding(spark):
    df = spark.createDataFrame([(1, i) for i in range(21)] + [(2, i) for i in range(3)], "g int, level int")
    kept = select.cap_even(df, ["g"], [c("level").asc()], 4)
    assert sorted(r["level"] for r in kept.where("g = 1").collect()) == [0, 7, 13, 20]
    assert kept.where("g = 2").count() == 3
    assert [r["level"] for r in select.cap_even(df, ["g"], [c("level").asc()], 1).where("g = 1").collect()] == [0]
    # a histogram of levels per scene, published with its cap of four
    sizes = {1: 2, 2: 705, 3: 621, 4: 1, 5: 2341, 6: 1, 7: 9, 9: 34, 12: 1, 21: 244}
    rows = [(f"{n}-{i}", k) for n, m in sizes.items() for i in range(m) for k in range(n)]
    assert len(rows) == 20_495
    assert select.cap_even(spark.createDataFrame(rows, "g string, level int"), ["g"], [c("level").asc()], 4).count() == 13_799


def test_bucket_golden(spark):
    assert spark.range(1).select(keys.bucket("salt", F.lit("scene1"))).first()[0] == 8216


def test_gate_outcomes(spark):
    df = spark.createDataFrame([(0.9, True), (0.2, True), (math.nan, True), (None, True), (math.nan, False), (math.inf, True)], "v double, a boolean")
    passed = lambda g: [r[0] for r in df.select(g["passed"]).collect()]
    assert passed(gates.gate(c("v"), 0.5, applicable=c("a"))) == [True, False, False, False, True, False]
    assert passed(gates.gate(c("v"), None, applicable=c("a"))) == [True, True, False, False, True, False]
    assert passed(gates.gate(c("v"), 0.5, False, c("a"))) == [False, True, False, False, True, False]


def test_cascade_mandatory_and_absent_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    with pytest.raises(ValueError):
        contract.drop_cascade(df, [contract.Rule("r", F.lit(True), "gone", True)])
    with pytest.warns(UserWarning):
        got = contract.drop_cascade(df, [contract.Rule("off", F.lit(True), "gone"), contract.Rule("no_s", c("s").isNull(), "s")])
    assert [r["drop_reason"] for r in got.orderBy("i").collect()] == ["no_s", None]
    with pytest.raises(ValueError):
        contract.require_columns(df, ["i", "z"])


def test_leak_audit_finds_each_injected_leak(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", None), (None, "train"), ("c", "train"), ("d", "val"), ("e", "train")], "scene_id string, split string")
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("d", "train"), ("e", "train")], "scene_id string, split string")
    got = {(r["problem"], r["scene"]) for r in reconcile.leak_audit(rows, split).collect()}
    assert got == {("both_sides", "a"), ("disagrees", "a"), ("no_side", "b"), ("no_scene", None), ("not_in_split", "c"), ("disagrees", "d")}


def test_guarded_corr_and_fit(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0), (2, 1.0, 3.0), (2, 2.0, 5.0), (2, 3.0, None)], "g int, x double, y double")
    got = {r["g"]: r for r in df.groupBy("g").agg(stats.guarded_corr(c("x"), c("y")).alias("r"), stats.guarded_corr(c("x"), c("y"), None).alias("n"), *stats.affine_fit("x", "y")).collect()}
    assert got[1]["r"] == 0.0 and got[1]["n"] is None and got[1]["slope"] is None
    assert abs(got[2]["r"] - 1) < 1e-12 and abs(got[2]["slope"] - 2) < 1e-12 and abs(got[2]["intercept"] - 1) < 1e-12


def test_student_and_wilcoxon_known_values():
    assert abs(inference.t_quantile(0.975, 2) - 4.302652729911275) < 1e-9
    assert abs(inference.t_quantile(0.975, 30) - 2.0422724563012373) < 1e-9
    assert abs(inference.t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12
    w, p = inference.wilcoxon_p(np.array([1.0, 2, 3, 4, 5, -6, 7, 8]))
    assert w == 6 and abs(p - 0.109375) < 1e-12
    assert math.isnan(inference.wilcoxon_p(np.zeros(3))[1])


def test_cluster_interval_depends_on_scenes_not_order(spark):
    random.seed(3)
    rows = [(f"s{i % 12}", (i % 12) / 10 + random.random() / 100) for i in range(600)]
    a = inference.cluster_interval(spark.createDataFrame(rows, "scene string, v double").withColumn("g", F.lit(1)), ["g"], "scene", "v", 500).first()
    random.shuffle(rows)
    b = inference.cluster_interval(spark.createDataFrame(rows, "scene string, v double").withColumn("g", F.lit(1)), ["g"], "scene", "v", 500).first()
    assert (a["n"], a["scenes"]) == (600, 12) and abs(a["lo"] - b["lo"]) < 1e-9 and abs(a["hi"] - b["hi"]) < 1e-9 and a["lo"] < a["mean"] < a["hi"]
    one = inference.cluster_interval(spark.createDataFrame([("s", 1.0)], "scene string, v double").withColumn("g", F.lit(1)), ["g"], "scene", "v").first()
    assert one["lo"] is None


def test_capped_draws_and_hypercube(spark):
    g = spark.createDataFrame([("x",), ("y",), (None,)], "g string")
    rows = sampling.latin_hypercube(g, "g", 5, "s").collect()
    for k in "xy":
        mine = [r for r in rows if r["g"] == k]
        assert sorted(int(r["u"] * 5) for r in mine) == sorted(int(r["v"] * 5) for r in mine) == list(range(5))
    w = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0), (4, None)], "k int, w double")
    n = {r["k"]: r["count"] for r in sampling.weighted_draws(w, "k", "w", 8000, "z").groupBy("k").count().collect()}
    assert set(n) == {2, 3} and sum(n.values()) == 8000 and abs(n[3] / 8000 - 0.75) < 0.03


def test_whole_groups_in_pilot(spark):
    df = spark.createDataFrame([(g, i) for g in range(30) for i in range(g % 5 + 1)] + [(None, 0)], "g int, i int")
    got = {r["g"]: r["count"] for r in sampling.pilot_groups(df, "g", 20, "s").groupBy("g").count().collect()}
    assert None not in got and all(n == g % 5 + 1 for g, n in got.items()) and 20 <= sum(got.values()) < 25


def test_kernels_against_analytic_surfaces():
    y, x = np.mgrid[0:41, 0:41] - 20.0
    r = 60.0
    sphere = np.sqrt(r * r - x * x - y * y)
    k = kernels.monge_signals(sphere[None])["K"][0]
    assert np.allclose(k[15:26, 15:26], 1 / r**2, rtol=0.02)
    assert np.allclose(kernels.monge_signals((0.3 * x + 0.2 * y)[None])["K"][0, 2:-2, 2:-2], 0, atol=1e-9)
    assert np.allclose(kernels.monge_signals(np.sqrt(r * r - x * x)[None])["K"][0, 2:-2, 2:-2], 0, atol=1e-6)
    f, R, d = 400.0, 2.0, 10.0  # a sphere of radius 2 m, 10 m away, seen through a pinhole
    v, u = np.mgrid[0:41, 0:41] - 20.0
    a, b = 1 + (u / f) ** 2 + (v / f) ** 2, -2 * d
    z = (-b - np.sqrt(b * b - 4 * a * (d * d - R * R))) / (2 * a)
    got = kernels.projected_curvature(z[None], f, f, 20.0, 20.0)[0]
    assert np.allclose(got[15:26, 15:26], 1 / R**2, rtol=0.03)


def test_kernels_simple_cases():
    one = np.zeros((1, 9, 9))
    one[0, 4, 4] = 1
    assert kernels.laplacian(one)[0, 4, 4] == -4 and kernels.laplacian(one)[0, 3, 4] == 1
    assert np.isclose(kernels.box_mean(np.ones((1, 5, 5)), 3), 1).all()
    assert np.isclose(kernels.ssim(one * 255, one * 255), 1).all()
    img = np.random.default_rng(0).random((1, 32, 32))
    dy, dx, resp = kernels.phase_shift(np.roll(img, (2, -3), (1, 2)), img)
    assert (dy[0], dx[0]) == (2, -3) and resp[0] > 5
    assert np.isclose(kernels.resample(img, 8, 8, "area").mean(), img.mean()) and kernels.resample(img, 32, 32, "bilinear").shape == img.shape
    assert kernels.erode(np.ones((5, 5), bool), 2).all() and kernels.dilate(one[0] > 0, 1).sum() == 9
    step = np.where(np.arange(16) < 8, 0.0, 1.0) * np.ones((1, 16, 1))
    assert kernels.boundary_scores(step, step)[2][0] == 1
    disc = (np.hypot(*(np.mgrid[0:65, 0:65] - 32)) <= 12).astype(float)
    assert abs(kernels.blur_radius(disc, 32, 32) - 12) < 1
    x, v, cens = kernels.bracketed_search(lambda s: -((s - np.array([1.3, 50.0])) ** 2), np.array([0.0, 0.0]), np.array([2.0, 2.0]), most=10)
    assert abs(x[0] - 1.3) < 1e-2 and list(cens) == [False, True]


def test_raster_nulls_and_wrong_sizes(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, None), (3, [1.0])], "i int, a array<double>")
    f = arrays.raster(kernels.laplacian_variance, 2, 2, "double")
    assert [r[0] for r in df.orderBy("i").select(f("a")).collect()] == [0.0, None, None]
    q = spark.createDataFrame([([0.0, 0.5, 1.0, None],)], "a array<double>").select(arrays.quantise_u16(c("a"), F.lit(0.0), F.lit(1.0)).alias("q"))
    assert q.first()["q"] == [0, 32768, 65535, None]


def test_name_and_reference_grammars(spark):
    df = spark.createDataFrame([("fp_train_f_12_level_3_aligned",), ("fp_train_f_12_level_0_aligned",), ("x_val_f_1_level_2_shift_3.5px",), ("fp_train_f_12_level_3",), (None,)], "s string")
    p = text.parse_name("s")
    rows = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert [r["valid"] for r in rows] == [True, False, True, False, False]
    assert rows[0]["scene_no"] == 12 and rows[0]["level"] == 3 and rows[2]["shift_px"] == 3.5 and rows[2]["alignment"] == "shift" and rows[1]["level"] is None
    refs = spark.createDataFrame([("r/x#train[7].aif",), ("a/b.png",), ("aif",), ("r#bad",), ("",), (None,)], "s string")
    assert [r[0] for r in refs.select(text.parse_reference("s")["kind"]).collect()] == ["row", "path", "column", "malformed", "malformed", None]
    scene = spark.createDataFrame([("blb_277_k00_d00",), ("rb_test_f_51_level_3_aligned",), ("realdof_10_aligned",)], "s string").select(text.scene_of_image(c("s")))
    assert [r[0] for r in scene.collect()] == ["blb_277", "rb_test_f_51", "realdof_10"]
    key = spark.createDataFrame([("ai_001_001__cam_00",), ("ai_1_2_3",), ("plain",)], "s string").select(text.scene_of_key(c("s")))
    assert [r[0] for r in key.collect()] == ["ai_001_001", "ai_1_2", "plain"]
    assert spark.range(1).select(text.local_number(F.lit(15423.25), 1)).first()[0] == "15.423,2"


def test_optics_errors_in_order(spark):
    df = spark.createDataFrame([(26.0, 2.0, 52.0, 2.0, 100, 200), (None, 2.0, 52.0, 2.0, 100, 200), (26.0, 2.0, None, 2.0, 100, 200), (26.0, None, 52.0, 2.0, 100, 200), (26.0, 2.0, 52.0, 0.01, 100, 200), (26.0, 2.0, 52.0, 2.0, 0, 200)], "f double, n double, e double, z double, h int, w int")
    k, e = numeric.k_from_optics(c("f"), c("n"), c("e"), c("z"), c("h"), c("w"))
    rows = df.select(k.alias("k"), e.alias("e")).collect()
    assert [r["e"] for r in rows] == [None, "exif_focal_length_missing", "sensor_width_unresolvable", "exif_f_number_missing", "focus_distance_below_focal_length", "resolution_invalid"]
    want = 26**2 * 2000 / (2 * 2 * (2000 - 26)) * (200 / (36 * 26 / 52)) / 1000
    assert abs(rows[0]["k"] - want) < 1e-12


def test_concentration_with_ties(spark):
    df = spark.createDataFrame([(v,) for v in [5.0] * 4 + [1.0] * 6 + [math.nan, None]], "v double")
    got = {r["top_share"]: r["carried"] for r in audits.concentration(df, "v", [0.2, 0.5]).collect()}
    assert abs(got[0.2] - 10 / 26) < 1e-12 and abs(got[0.5] - 21 / 26) < 1e-12


def test_profile_of_small_loads(spark):
    df = spark.createDataFrame([(1, v) for v in [0.1, 0.5, math.nan, None, 2.0]] + [(2, None), (None, 0.5)] + [(3, 0.9), (3, 0.7)], "r int, v double")
    prev = spark.createDataFrame([(3, 1), (2, 1)], "load int, prev_load int")
    freq = quality.frequencies(quality.unpivot(df, "r", {"v": "v"}))
    got = {r["load"]: r for r in quality.profile(freq, prev, lambda n, v: v.between(0, 1)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["rows"], got[1]["nulls"], got[1]["distincts"], got[1]["outside"]) == (5, 1, 4, 2) and abs(got[1]["q_50"] - 0.3) < 1e-12
    assert got[2]["q_50"] is None and got[2]["nulls"] == 1
    assert abs(got[3]["ks"] - 2 / 3) < 1e-12 and got[2]["ks"] is None


def test_profile_of_strings_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab", [1.0, 2.0]), (1, "ab", None), (1, "", []), (1, None, [None]), (1, "a1", [2.0]), (2, "zz", None), (None, "x", [9.0])], "r int, s string, k array<double>")
    none = spark.createDataFrame([], "load int, prev_load int")
    freq = quality.frequencies(quality.unpivot(df, "r", {"s": "s", "k": "elements"}))
    got = {(r["load"], r["column_name"]): r for r in quality.profile(freq, none, lambda n, v: v < 2, "[a-z]*").collect()}
    assert set(got) == {(1, "s"), (2, "s"), (1, "elements")}
    s, k = got[1, "s"], got[1, "elements"]
    assert (s["rows"], s["nulls"], s["distincts"], s["breaches"], s["outside"], s["q_50"]) == (5, 1, 3, 1, None, None)
    assert (k["rows"], k["nulls"], k["distincts"], k["outside"], k["breaches"], k["q_50"], k["least"], k["most"]) == (4, 1, 2, 2, None, 1.0, 1.0, 2.0)
    assert quality.profile(freq.limit(0), none, lambda n, v: v < 2).count() == 0


def test_keep_calibrated_decides_over_all_rows(spark):
    late = [("late", i, None if i % 2 else 0.0, 1.0) for i in range(2500)] + [("late", 2500, 0.95, 2.0), ("late", 2501, 0.95, 0.0), ("late", 2502, 0.5, 2.0)]
    never = [("never", 3000, None, 1.0), ("never", 3001, 0.0, 0.0), ("never", 3002, -1.0, 1.0), ("never", 3003, math.nan, 1.0)]
    df = spark.createDataFrame(late + never, "s string, i int, score double, k double")
    got = contract.keep_calibrated(df, "s", "score", 0.9, "k")
    assert got.columns == df.columns and sorted(r["i"] for r in got.collect()) == [2500, 3000, 3001, 3002, 3003]
