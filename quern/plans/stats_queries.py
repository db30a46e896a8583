"""Queries of aggregates, statistics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import audits, inference, ranking, stats
from quern.plans.registry import Registry, table

R = Registry()
c = F.col


def _r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@R.query("WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT n AS group_size, count(*) AS n_groups, CAST(n * count(*) AS BIGINT) AS n_rows FROM s GROUP BY n")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_size_histogram(table(spark, d, "lineitem"), "l_orderkey")


@R.query("""SELECT route, count(*) AS seen, CAST(count(*) FILTER (scene_id IS NULL) AS BIGINT) AS no_scene, CAST(count(*) FILTER (calibration_ssim IS NULL) AS BIGINT) AS no_ssim,
CAST(count(*) FILTER (is_k_censored) AS BIGINT) AS censored, round(count(*) FILTER (is_k_censored) / count(*), 9) AS censored_share FROM manifest GROUP BY route""")
def conditional_exclusion_counters(spark: SparkSession, d: str) -> DataFrame:
    x = stats.exclusion_counters(table(spark, d, "manifest"), "route", {"no_scene": c("scene_id").isNull(), "no_ssim": c("calibration_ssim").isNull()}, c("is_k_censored"))
    return _r(x, 9, "censored_share")


@R.query("""SELECT route, count(*) AS n, count(DISTINCT scene_id) AS scenes, count(DISTINCT sample_id) AS samples, round(avg(k_value) FILTER (k_value > 0 AND k_value < 1e300), 6) AS mean_k,
CAST(count(*) FILTER (is_valid_for_control) AS BIGINT) AS valid FROM manifest GROUP BY route""")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").groupBy("route")
    return m.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scene_id").alias("scenes"), F.countDistinct("sample_id").alias("samples"), F.round(F.avg(F.when((c("k_value") > 0) & (c("k_value") < 1e300), c("k_value"))), 6).alias("mean_k"), F.count_if("is_valid_for_control").alias("valid"))


@R.query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [i / 100.0 FOR i IN range(101)]) AS v FROM lineitem) SELECT CAST(i AS INTEGER) AS knot, i / 100.0 AS q, round(v[i + 1], 4) AS value FROM q, range(101) t(i)""".replace("[i / 100.0 FOR i IN range(101)]", "[" + ", ".join(str(i / 100) for i in range(101)) + "]"))
def quantile_function(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.quantile_function(table(spark, d, "lineitem"), "l_extendedprice"), 4, "value")


@R.query("""WITH v AS (SELECT route, k_value AS k FROM manifest WHERE k_value > 0 AND CAST(k_value AS VARCHAR) NOT IN ('nan', 'inf') AND route IS NOT NULL),
s AS (SELECT route, count(*) AS n, count(DISTINCT k) AS distinct_k, quantile_cont(k, 0.01) AS p01, quantile_cont(k, 0.99) AS p99 FROM v GROUP BY 1)
SELECT route, n, distinct_k, round(p01, 6) AS p01, round(p99, 6) AS p99, CASE WHEN n < 3000 THEN 'too_few_rows' WHEN distinct_k < 3000 THEN 'too_few_values' WHEN p01 <= 0 OR p99 / p01 < 1.05 THEN 'no_spread' END AS reason FROM s""")
def degenerate_distributions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "manifest").where("k_value > 0 and not isnan(k_value) and route is not null and k_value < double('inf')")
    q = ranking.quantiles(v, ["route"], "k_value", {"p01": 0.01, "p99": 0.99})
    n = v.groupBy("route").agg(F.countDistinct("k_value").alias("distinct_k"))
    x = q.join(F.broadcast(n), "route").withColumn("reason", stats.degenerate_reason(c("n"), c("distinct_k"), c("p01"), c("p99"), 3000))
    return _r(x, 6, "p01", "p99").select("route", "n", "distinct_k", "p01", "p99", "reason")


_NEAREST = "list_sort(list(v))[CAST(round_even({q} * (count(*) - 1), 0) AS BIGINT) + 1]"


@R.query(f"""WITH x AS (SELECT lang AS metric, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL),
s AS (SELECT metric, count(*) AS n, [{_NEAREST.format(q=0.05)}, {_NEAREST.format(q=0.1)}, {_NEAREST.format(q=0.25)}] AS cuts FROM x GROUP BY 1),
p AS (SELECT metric, n, unnest([5, 10, 25]) AS percent, unnest(cuts) AS cutoff FROM s)
SELECT metric, percent, cutoff, CAST(count(*) FILTER (x.v < cutoff) AS BIGINT) AS dropped, round(count(*) FILTER (x.v < cutoff) / n, 9) AS dropped_share FROM p JOIN x USING (metric) GROUP BY metric, percent, cutoff, n""")
def threshold_proposals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("lang is not null").select(c("lang").alias("metric"), c("n_chars").cast("double").alias("v"))
    return _r(stats.threshold_proposals(x, "metric", "v", [5, 10, 25]), 9, "dropped_share")


@R.query("""WITH x AS (SELECT calibration_ssim AS s, is_valid_for_control AS good FROM manifest WHERE calibration_ssim IS NOT NULL AND CAST(calibration_ssim AS VARCHAR) <> 'nan' AND is_valid_for_control IS NOT NULL),
f AS (SELECT s, count(*) AS n, count(*) FILTER (good) AS g FROM x GROUP BY s), r AS (SELECT s, sum(n) OVER w AS n, sum(g) OVER w AS g FROM f WINDOW w AS (ORDER BY s DESC)),
b AS (SELECT max(s) FILTER (g / n < 0.8) AS bad, max(g) AS whole FROM r) SELECT s AS threshold, round(g / n, 9) AS precision, round(g / whole, 9) AS recall, CAST(n AS BIGINT) AS retained FROM r, b WHERE bad IS NULL OR s > bad ORDER BY s LIMIT 1""")
def stable_precision_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.stable_threshold(table(spark, d, "manifest"), "calibration_ssim", "is_valid_for_control", 0.8), 9, "precision", "recall")


@R.query("""WITH x AS (SELECT l_partkey AS scene, l_extendedprice / l_quantity / p_retailprice AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
y AS (SELECT 'row' AS level, r FROM x UNION ALL SELECT 'scene', quantile_cont(r, 0.5) FROM x GROUP BY scene)
SELECT level, round(avg(CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE 0 END), 9) AS within_10, round(avg(CASE WHEN abs(r - 1) <= 0.25 THEN 1.0 ELSE 0 END), 9) AS within_25, round(avg(CASE WHEN abs(r - 1) <= 0.5 THEN 1.0 ELSE 0 END), 9) AS within_50,
count(*) AS n, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.95), 6) AS p95 FROM y GROUP BY level""")
def agreement_two_level(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    x = x.select(c("l_partkey").alias("scene"), (c("l_extendedprice") / c("l_quantity") / c("p_retailprice")).alias("r"))
    return _r(_r(stats.agreement(x, "r", "scene"), 9, "within_10", "within_25", "within_50"), 6, "p05", "median", "p95")


_PAIRED = "SELECT user_id, avg(value) FILTER (ts < '2024-01-16') AS a, avg(value) FILTER (ts >= '2024-01-16') AS b FROM events GROUP BY user_id"


def _halves(spark: SparkSession, d: str) -> DataFrame:
    late = c("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(~late, c("value"))).alias("a"), F.avg(F.when(late, c("value"))).alias("b"))


@R.query(f"WITH p AS ({_PAIRED}) SELECT count(*) AS pairs, CAST(count(*) FILTER (b - a < -1e-9) AS BIGINT) AS improved, CAST(count(*) FILTER (b - a > 1e-9) AS BIGINT) AS worse, CAST(count(*) FILTER (abs(b - a) <= 1e-9) AS BIGINT) AS tied, round(avg(b - a), 6) AS mean_delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.paired_counts(_halves(spark, d), "a", "b"), 6, "mean_delta")


@R.query(f"""WITH p AS ({_PAIRED}), x AS (SELECT user_id % 5 AS arm, b - a AS dl FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT arm, count(*) AS scenes, round(avg(dl), 6) AS mean_delta, round(avg(dl) / (stddev_samp(dl) / sqrt(count(*))), 6) AS t_stat, round(avg(CASE WHEN dl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM x GROUP BY arm""")
def t_statistic(spark: SparkSession, d: str) -> DataFrame:
    h = _halves(spark, d).withColumn("arm", c("user_id") % 5)
    x = inference.compare_paired(h, ["arm"], "user_id", "b", "a", draws=200)
    return _r(x.select("arm", "scenes", "mean_delta", "t_stat", "win_rate"), 6, "mean_delta", "t_stat", "win_rate")


@R.query()
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("route is not null")
    return inference.compare_paired(m, ["route"], "scene_id", "focus_agreement", "focus_retention_in_region", draws=1000)


@R.query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return inference.cluster_interval(table(spark, d, "manifest"), ["source_dataset"], "scene_id", "focus_agreement", draws=1000)


_Z = 1.959963984540054
#: The 97.5 % quantiles of Student's t with 1 to 30 degrees of freedom; beyond, the expansion about the normal one.
_T30 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450,
        2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]
_T = f"CASE WHEN v <= 30 THEN ({_T30})[v::INTEGER] ELSE " + " + ".join([repr(_Z), f"{(_Z**3 + _Z) / 4!r} / v", f"{(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow(v, 2)", f"{(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow(v, 3)"]) + " END"


@R.query(f"""WITH x AS (SELECT k_source, count(*) AS n, avg(focus_agreement) AS m, stddev_samp(focus_agreement) / sqrt(count(*)) AS se, count(*) - 1.0 AS v FROM manifest WHERE focus_agreement IS NOT NULL AND CAST(focus_agreement AS VARCHAR) NOT IN ('nan', 'inf', '-inf') GROUP BY 1)
SELECT k_source, n, round(m, 4) AS mean, round(m - ({_T}) * se, 4) AS lo, round(m + ({_T}) * se, 4) AS hi FROM x""")
def student_interval(spark: SparkSession, d: str) -> DataFrame:
    return _r(inference.mean_interval(table(spark, d, "manifest"), ["k_source"], "focus_agreement"), 4, "mean", "lo", "hi")


@R.query("""WITH x AS (SELECT row_id, rank() OVER (ORDER BY abs(focus_agreement - 0.6)) + (count(*) OVER (PARTITION BY abs(focus_agreement - 0.6)) - 1) / 2.0 AS r, sign(focus_agreement - 0.6) AS s FROM manifest
WHERE focus_agreement IS NOT NULL AND CAST(focus_agreement AS VARCHAR) <> 'nan' AND focus_agreement <> 0.6) SELECT round(sum(r) FILTER (s > 0), 3) AS up, round(sum(r) FILTER (s < 0), 3) AS down FROM x""")
def signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    from quern.operators.prefix import prefix_sums

    x = table(spark, d, "manifest").where("focus_agreement is not null and not isnan(focus_agreement) and focus_agreement <> 0.6").withColumn("g", F.abs(c("focus_agreement") - 0.6))
    f = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("focus_agreement") > 0.6).alias("up"))
    mid = c("cum_n") - (c("n") - 1) / 2.0
    return prefix_sums(f, [], [c("g").asc()], ["n"]).agg(F.round(F.sum(mid * c("up")), 3).alias("up"), F.round(F.sum(mid * (c("n") - c("up"))), 3).alias("down"))


@R.query("""WITH m AS (SELECT o_orderstatus AS bench, o_orderpriority AS arm, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT a.bench, a.arm, round(a.v, 4) AS v, round(a.v - b.v, 4) AS margin FROM m a LEFT JOIN m b ON a.bench = b.bench AND b.arm = '1-URGENT'""")
def baseline_margin(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(c("o_orderstatus").alias("bench"), c("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    return _r(stats.margin_over(m, "bench", "arm", "v", "1-URGENT"), 4, "v", "margin")


@R.query("""WITH m AS (SELECT o_custkey % 6 AS seed, o_orderpriority AS arm, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), x AS (SELECT a.arm, a.v - b.v AS dl FROM m a JOIN m b ON a.seed = b.seed AND b.arm = '5-LOW' WHERE a.arm <> '5-LOW')
SELECT arm, count(*) AS seeds, round(avg(dl), 4) AS mean_delta, round(stddev_samp(dl), 4) AS sd_delta, CAST(count(*) FILTER (dl > 0) AS BIGINT) AS wins FROM x GROUP BY arm""")
def seed_deltas(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy((c("o_custkey") % 6).alias("seed"), c("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("v"))
    return _r(stats.seed_deltas(m, "seed", "arm", "v", "5-LOW"), 4, "mean_delta", "sd_delta")


@R.query("""WITH m AS (SELECT l_returnflag, l_orderkey, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS scenes, round(avg(v), 4) AS mean, round(stddev_samp(v) / sqrt(count(*)), 4) AS sem FROM m GROUP BY 1""")
def sem_two_level(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.scene_mean_error(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", ["l_returnflag"]), 4, "mean", "sem")


@R.query("""SELECT l_partkey, count(*) AS n, round(coalesce(covar_pop(l_quantity, l_discount) / nullif(stddev_pop(l_quantity) * stddev_pop(l_discount), 0), 0.0), 6) AS r FROM lineitem GROUP BY 1""")
def guarded_corr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(stats.guarded_corr(c("l_quantity"), c("l_discount")), 6).alias("r"))


@R.query("""WITH g AS (SELECT l_partkey, -covar_pop(l_quantity, l_discount) / nullif(stddev_pop(l_quantity) * stddev_pop(l_discount), 0) AS r FROM lineitem GROUP BY 1) SELECT count(*) AS groups_all, count(r) AS varying, round(avg(r), 6) AS mean_corr FROM g""")
def corr_mean_of_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg((-stats.guarded_corr(c("l_quantity"), c("l_discount"), None)).alias("r"))
    return g.agg(F.count(F.lit(1)).alias("groups_all"), F.count("r").alias("varying"), F.round(F.avg("r"), 6).alias("mean_corr"))


@R.query("""SELECT p_brand, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def affine_fit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).groupBy("p_brand").agg(*stats.affine_fit("l_quantity", "l_extendedprice"))
    return _r(_r(x, 4, "slope", "intercept"), 6, "r2")


@R.query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, max(abs(l_extendedprice)) AS top FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 4) AS slope, round(b, 4) AS intercept, round(max(abs(l_extendedprice - a * l_quantity - b)), 3) AS max_residual, max(abs(l_extendedprice - a * l_quantity - b)) <= 0.5 * top AS linear FROM lineitem JOIN f USING (l_returnflag) GROUP BY l_returnflag, a, b, top""")
def line_with_residual(spark: SparkSession, d: str) -> DataFrame:
    x = stats.line_with_residual(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 0.5)
    return _r(_r(x, 4, "slope", "intercept"), 3, "max_residual").drop("r2")


@R.query("""WITH x AS (SELECT p_brand AS b, l_quantity * 10 AS p, l_extendedprice / 100 AS t FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT b, covar_pop(p, t) / greatest(var_pop(p), 1e-8) AS a, avg(p) AS mp, avg(t) AS mt FROM x GROUP BY b),
y AS (SELECT b, greatest(a * (p - mp) + mt, 1e-6) AS p, greatest(t, 1e-6) AS t FROM x JOIN f USING (b) WHERE t > 1e-6)
SELECT b AS p_brand, round(avg(abs(p - t) / t), 6) AS abs_rel, round(avg((p - t) ^ 2 / t), 4) AS sq_rel, round(sqrt(avg((p - t) ^ 2)), 4) AS rmse, round(sqrt(avg((ln(p) - ln(t)) ^ 2)), 6) AS rmse_log, round(avg(abs(log10(p) - log10(t))), 6) AS log10,
round(avg(CASE WHEN greatest(p / t, t / p) < 1.25 THEN 1.0 ELSE 0 END), 6) AS d1, round(avg(CASE WHEN greatest(p / t, t / p) < 1.5625 THEN 1.0 ELSE 0 END), 6) AS d2, round(avg(CASE WHEN greatest(p / t, t / p) < 1.953125 THEN 1.0 ELSE 0 END), 6) AS d3 FROM y GROUP BY b""")
def depth_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    x = x.select("p_brand", (c("l_quantity") * 10).alias("p"), (c("l_extendedprice") / 100).alias("t"))
    return _r(_r(stats.affine_metrics(x, "p_brand", "p", "t"), 6, "abs_rel", "rmse_log", "log10", "d1", "d2", "d3"), 4, "sq_rel", "rmse")


@R.query("""SELECT source_dataset, round(avg(v), 6) AS mean, round(list_sort(list(v) FILTER (v IS NOT NULL))[CAST(count(v) // 2 AS BIGINT) + 1], 6) AS upper_median, min(v) AS least, max(v) AS most, CAST(count(*) - count(v) AS BIGINT) AS failures
FROM (SELECT source_dataset, CASE WHEN CAST(calibration_ssim AS VARCHAR) <> 'nan' THEN calibration_ssim END AS v FROM manifest WHERE source_dataset IS NOT NULL) GROUP BY 1""")
def upper_median_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("source_dataset is not null").select("source_dataset", F.when(~F.isnan("calibration_ssim"), c("calibration_ssim")).alias("v"))
    return _r(stats.summary_upper_median(m, ["source_dataset"], "v"), 6, "mean", "upper_median")


@R.query("""WITH x AS (SELECT route, k_value / max_coc AS r FROM manifest WHERE CAST(k_value / max_coc AS VARCHAR) NOT IN ('nan', 'inf', '-inf') AND route IS NOT NULL), g AS (SELECT quantile_cont(r, 0.5) AS m FROM x)
SELECT route, count(*) AS n, round(avg(r), 6) AS mean_ratio, round(avg(r / m), 6) AS rescaled FROM x, g GROUP BY route""")
def rescaled_by_median(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "manifest").where("route is not null").select("route", F.try_divide("k_value", "max_coc").alias("r"))
    return _r(stats.rescaled_by_median(x, "r", "route"), 6, "mean_ratio", "rescaled")


@R.query("""WITH m AS (SELECT scene_id, avg(focus_agreement) AS v FROM manifest WHERE scene_id IS NOT NULL AND CAST(focus_agreement AS VARCHAR) <> 'nan' GROUP BY 1) SELECT scene_id, round(v, 6) AS scene_mean FROM m WHERE v IS NOT NULL""")
def group_by_scene(spark: SparkSession, d: str) -> DataFrame:
    s = inference.scene_sums(table(spark, d, "manifest"), [], "scene_id", "focus_agreement")
    return s.select("scene_id", F.round(c("_sum") / c("_n"), 6).alias("scene_mean"))


@R.query("SELECT route, arg_max(row_id, (k_value, -row_id)) AS row_id FROM manifest WHERE route IS NOT NULL AND k_value IS NOT NULL AND CAST(k_value AS VARCHAR) <> 'nan' GROUP BY 1")
def best_row(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("route is not null and k_value is not null and not isnan(k_value)").select("route", "k_value", "row_id")
    return stats.best_row(m, ["route"], "k_value", ["row_id"]).select("route", "row_id")


@R.query("SELECT route, list_sort(list(DISTINCT bokeh_role)) AS items, count(*) AS n, CAST(sum(bokeh_jpeg_bytes) AS BIGINT) AS total_size FROM generated_images GROUP BY 1")
def size_inventory(spark: SparkSession, d: str) -> DataFrame:
    return stats.size_inventory(table(spark, d, "generated_images").withColumn("bokeh_role", c("bokeh_role")), "route", "bokeh_role", "bokeh_jpeg_bytes")


_SCALE = """WITH RECURSIVE daily AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM daily WHERE v IS NOT NULL),
s AS (SELECT event_type, k, v AS scale FROM r WHERE k = 1 UNION ALL SELECT s.event_type, r.k, {step} FROM s JOIN r ON r.event_type = s.event_type AND r.k = s.k + 1)
SELECT event_type, round(arg_max(scale, k), 9) AS scale, CAST(max(k) AS INTEGER) AS steps FROM s GROUP BY 1"""
_EMA = "0.9 * s.scale + (1 - 0.9) * least(r.v, 10.0 * s.scale)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@R.query(_SCALE.format(step=_EMA))
def moving_scale(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.moving_scale(_daily(spark, d), "event_type", "day", "v"), 9, "scale")


@R.query(_SCALE.format(step=f"CASE WHEN s.k >= 5 THEN s.scale ELSE {_EMA} END"))
def frozen_scale(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.moving_scale(_daily(spark, d), "event_type", "day", "v", freeze_after=5), 9, "scale")


_ROUTES = "SELECT route, k_value AS k, coalesce(is_k_censored, false) AS cens FROM manifest WHERE k_value > 0 AND CAST(k_value AS VARCHAR) NOT IN ('nan', 'inf')"


@R.query(f"""WITH v AS ({_ROUTES}), s AS (SELECT route, count(*) AS n, count(DISTINCT k) AS distincts, avg(cens::INT) AS cs, quantile_cont(k, 0.01) AS p01, quantile_cont(k, 0.99) AS p99, true AS one FROM v WHERE route IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, count(*), count(DISTINCT k), avg(cens::INT), quantile_cont(k, 0.01), quantile_cont(k, 0.99), false FROM v)
SELECT route, n, distincts, round(cs, 9) AS censored_share, round(p01, 6) AS p01, round(p99, 6) AS p99, CASE WHEN NOT one AND n < 32 THEN 'too_few_rows' WHEN distincts < CASE WHEN one THEN 8 ELSE 32 END THEN 'too_few_values'
  WHEN NOT one AND (p01 <= 0 OR p99 / p01 < 1.05) THEN 'no_spread' WHEN cs > 0.25 THEN 'too_many_censored' END AS reason FROM s""")
def distribution_checks(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(stats.distribution_checks(table(spark, d, "manifest"), "k_value", "route", "is_k_censored"), 6, "p01", "p99"), 9, "censored_share")


@R.query("""WITH v AS (SELECT route, k_value AS k FROM manifest WHERE k_value > 0 AND CAST(k_value AS VARCHAR) NOT IN ('nan', 'inf') AND route IS NOT NULL)
SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 9) AS share, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS sd, round(quantile_cont(k, 0.05), 6) AS p05, round(quantile_cont(k, 0.5), 6) AS median, round(quantile_cont(k, 0.95), 6) AS p95 FROM v GROUP BY 1""")
def run_spread(spark: SparkSession, d: str) -> DataFrame:
    """Share, mean, spread and percentiles of a measure of each route, of finite positive values."""
    v = table(spark, d, "manifest").where("route is not null and k_value > 0 and not isnan(k_value) and k_value < double('inf')")
    return _r(_r(stats.spread_by_group(v, "route", "k_value"), 6, "mean", "sd", "p05", "median", "p95"), 9, "share")


@R.query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice DESC) AS rn, count(*) OVER () AS n, sum(l_extendedprice) OVER () AS t FROM lineitem),
s AS (SELECT unnest([0.0001, 0.001, 0.01, 0.1])::DOUBLE AS top_share) SELECT top_share, CAST(greatest(floor(top_share * any_value(n)), 1) AS BIGINT) AS n_top, round(sum(v) FILTER (rn <= greatest(floor(top_share * n), 1)) / any_value(t), 9) AS carried FROM s, r GROUP BY top_share""")
def concentration_curve(spark: SparkSession, d: str) -> DataFrame:
    return _r(audits.concentration(table(spark, d, "lineitem"), "l_extendedprice", [0.0001, 0.001, 0.01, 0.1]), 9, "carried")


@R.query("""SELECT cap, round(avg(CASE WHEN l_extendedprice > cap THEN 1.0 ELSE 0 END), 9) AS saturated, round(sum(least(l_extendedprice, cap)) / sum(l_extendedprice), 9) AS kept FROM lineitem, (SELECT unnest([5000.0, 20000.0, 60000.0])::DOUBLE AS cap) GROUP BY cap""")
def clamp_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    return _r(audits.clamp_tradeoff(table(spark, d, "lineitem"), "l_extendedprice", [5000.0, 20000.0, 60000.0]), 9, "saturated", "kept")


@R.query("""WITH b AS (SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity < 45 THEN 2 END AS bin_no, l_extendedprice AS v FROM lineitem)
SELECT bin_no, [1.0, 10.0, 25.0][bin_no + 1]::DOUBLE AS lo, [10.0, 25.0, 45.0][bin_no + 1]::DOUBLE AS hi, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 9) AS share, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99 FROM b WHERE bin_no IS NOT NULL GROUP BY bin_no""")
def binned_profile(spark: SparkSession, d: str) -> DataFrame:
    x = audits.binned_profile(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [1.0, 10.0, 25.0, 45.0], {"p50": 0.5, "p99": 0.99})
    return _r(_r(x, 9, "share"), 4, "p50", "p99")


@R.query("""SELECT cutoff, round(avg(CASE WHEN l_quantity >= cutoff THEN 1.0 ELSE 0 END), 9) AS kept, round(avg(l_extendedprice) FILTER (l_quantity >= cutoff), 4) AS mean_value, round(avg(CASE WHEN l_extendedprice > 40000 THEN 1.0 ELSE 0 END) FILTER (l_quantity >= cutoff), 9) AS exceed
FROM lineitem, (SELECT unnest([1.0, 20.0, 40.0])::DOUBLE AS cutoff) GROUP BY cutoff""")
def filter_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(audits.filter_sweep(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [1.0, 20.0, 40.0], 40000.0), 9, "kept", "exceed"), 4, "mean_value")


@R.query("""SELECT cutoff, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, round(quantile_cont(l_extendedprice, 0.999), 4) AS p99_9
FROM lineitem JOIN (SELECT unnest([1.0, 20.0, 40.0])::DOUBLE AS cutoff) ON l_quantity >= cutoff GROUP BY cutoff""")
def filter_sweep_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _r(audits.filter_sweep_quantiles(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [1.0, 20.0, 40.0], {"p50": 0.5, "p99": 0.99, "p99_9": 0.999}), 4, "p50", "p99", "p99_9")


@R.query("""WITH v AS (SELECT unnest([{'c': 'route', 'v': route}, {'c': 'k_source', 'v': k_source}, {'c': 'image_h', 'v': CAST(image_h AS VARCHAR)}], recursive := true) FROM manifest), f AS (SELECT c, v, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k FROM f WHERE v IS NOT NULL), s AS (SELECT c, CAST(sum(n) AS BIGINT) AS rows_in, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null, count(v) AS distincts, min(v) AS least, max(v) AS most FROM f GROUP BY c),
t AS (SELECT c, list(v ORDER BY k) FILTER (k <= 8) AS top_values, max(v) FILTER (k = 1) AS mode, max(n) AS m FROM r GROUP BY c)
SELECT c AS column_name, rows_in, non_null, distincts, least, most, top_values, mode, round(m / non_null, 9) AS mode_share, distincts = 1 AS homogeneous FROM s LEFT JOIN t USING (c)
UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return _r(audits.column_profile(table(spark, d, "manifest"), ["route", "k_source", "image_h", "absent"]), 9, "mode_share")


@R.query("""SELECT measure, is_k_censored, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT is_k_censored, unnest([{'measure': 'focus_disparity', 'v': focus_disparity}, {'measure': 'focus_region_area_ratio', 'v': focus_region_area_ratio}], recursive := true) FROM manifest WHERE is_k_censored IS NOT NULL)
WHERE v IS NOT NULL AND CAST(v AS VARCHAR) NOT IN ('nan', 'inf', '-inf') GROUP BY 1, 2""")
def two_way_contrast(spark: SparkSession, d: str) -> DataFrame:
    return _r(audits.two_way_contrast(table(spark, d, "manifest"), "is_k_censored", ["focus_disparity", "focus_region_area_ratio"]), 6, "q25", "q50", "q75")


@R.query("""SELECT CASE WHEN l_discount > 0.08 AND l_tax < 0.02 THEN 'contradictory' WHEN l_quantity <= 1 THEN 'degenerate' WHEN l_extendedprice > 50000 THEN 'saturated' ELSE 'ok' END AS class, count(*) AS n FROM lineitem GROUP BY 1""")
def ordered_classification(spark: SparkSession, d: str) -> DataFrame:
    k = F.when((c("l_discount") > 0.08) & (c("l_tax") < 0.02), "contradictory").when(c("l_quantity") <= 1, "degenerate").when(c("l_extendedprice") > 50000, "saturated").otherwise("ok")
    return table(spark, d, "lineitem").groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH x AS (SELECT l_extendedprice / l_quantity AS t, p_retailprice AS a, p_retailprice * (1 - l_discount) AS b, l_quantity > 30 AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0), y AS (SELECT 'all' AS part, * FROM x UNION ALL SELECT 'subset', * FROM x WHERE s)
SELECT part, count(*) AS n, CAST(count(*) FILTER (abs(a - t) < abs(b - t)) AS BIGINT) AS a_wins, round(count(*) FILTER (abs(a - t) < abs(b - t)) / count(*), 9) AS win_rate FROM y GROUP BY part""")
def candidate_contest(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    x = x.select((c("l_extendedprice") / c("l_quantity")).alias("t"), c("p_retailprice").alias("a"), (c("p_retailprice") * (1 - c("l_discount"))).alias("b"), (c("l_quantity") > 30).alias("s"))
    return _r(audits.contest(x, "a", "b", "t", c("s")), 9, "win_rate")


@R.query("""SELECT route, count(*) AS n, round(avg(CASE WHEN coalesce(abs(focus_disparity - 0.5) / 0.5 < 0.5, false) AND coalesce(abs(k_value - 15) / 15 < 0.5, false) THEN 1.0 ELSE 0 END), 9) AS good_share, good_share >= 0.2 AS consistent FROM manifest GROUP BY route""")
def consistency_verdict(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("route", numeric.relative_error(c("focus_disparity"), F.lit(0.5)).alias("e1"), numeric.relative_error(c("k_value"), F.lit(15.0)).alias("e2"))
    return _r(audits.consistency_verdict(m, "route", ["e1", "e2"], 0.5, 0.2), 9, "good_share")


@R.query("""WITH x AS (SELECT p_brand AS g, p_retailprice AS v, CAST(p_size AS DOUBLE) AS q FROM part), o AS (SELECT g, quantile_cont(q, 0.5) AS m FROM x GROUP BY g), a AS (SELECT quantile_cont(q, 0.5) AS m FROM x),
y AS (SELECT 'own' AS way, v * o.m AS v FROM x JOIN o USING (g) UNION ALL SELECT 'global', v * a.m FROM x, a) SELECT way, count(*) AS n, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95 FROM y GROUP BY way""")
def own_against_global(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_brand", "p_retailprice", c("p_size").cast("double").alias("q"))
    return _r(audits.own_against_global(x, "p_brand", "p_retailprice", "q"), 4, "p05", "p50", "p95")


@R.query("""WITH t AS (SELECT unnest([{'term': 'k_value', 'v': k_value}, {'term': 'max_coc', 'v': max_coc}], recursive := true) FROM manifest), x AS (FROM t WHERE v IS NOT NULL AND CAST(v AS VARCHAR) NOT IN ('nan', 'inf', '-inf'))
SELECT term, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(CASE WHEN v >= 100 THEN 1.0 ELSE 0 END), 9) AS saturated FROM x GROUP BY term""")
def term_scales(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(audits.term_scales(table(spark, d, "manifest"), ["k_value", "max_coc"], 100.0), 6, "p50", "p99"), 9, "saturated")


@R.query("""WITH m AS (SELECT o_orderpriority AS p, CASE o_orderstatus WHEN 'X' THEN 'F' ELSE o_orderstatus END AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT p AS o_orderpriority, coalesce(format('{:.2f}', round(max(v) FILTER (s = 'F'), 2)), 'n/d') AS "F", coalesce(format('{:.2f}', round(max(v) FILTER (s = 'O'), 2)), 'n/d') AS "O", coalesce(format('{:.2f}', round(max(v) FILTER (s = 'Z'), 2)), 'n/d') AS "Z" FROM m GROUP BY p""")
def pivot_report(spark: SparkSession, d: str) -> DataFrame:
    return audits.pivot_report(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "Z"], "o_totalprice")


_OPT = "(26.0 * 26.0 * z / (2.0 * f * (z - 26.0))) * (greatest(h, w) / (36.0 * 26.0 / 52.0)) / 1000"


@R.query(f"""WITH x AS (SELECT row_id, CASE WHEN focus_disparity > 0 THEN 1000.0 / focus_disparity END AS z, CASE WHEN row_id % 11 = 0 THEN NULL ELSE 2.0 + row_id % 5 END AS f, image_h AS h, image_w AS w FROM manifest)
SELECT row_id, CASE WHEN NOT coalesce(h > 0 AND w > 0, false) THEN 'resolution_invalid' WHEN f IS NULL THEN 'exif_f_number_missing' WHEN NOT coalesce(z > 26.0 AND CAST(z AS VARCHAR) <> 'nan', false) THEN 'focus_distance_below_focal_length' END AS error,
CASE WHEN error IS NULL THEN round({_OPT}, 6) END AS k FROM x""")
def optics_pipeline(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    z = F.when((c("focus_disparity") > 0) & ~F.isnan("focus_disparity"), F.try_divide(F.lit(1.0), c("focus_disparity")))
    f = F.when(c("row_id") % 11 != 0, 2.0 + c("row_id") % 5)
    k, e = numeric.k_from_optics(F.lit(26.0), f, F.lit(52.0), z, c("image_h"), c("image_w"))
    return m.select("row_id", e.alias("error"), F.round(k, 6).alias("k"))


@R.query("""WITH x AS (SELECT image_id, image_h AS h, image_w AS w, 512.0 / least(image_h, image_w) AS s FROM aif_images WHERE image_h > 0 AND image_w > 0), y AS (SELECT image_id, CAST(round_even(h * s, 0) AS INTEGER) AS scaled_h, CAST(round_even(w * s, 0) AS INTEGER) AS scaled_w FROM x)
SELECT image_id, scaled_h, scaled_w, scaled_h - scaled_h % 16 AS crop_h, scaled_w - scaled_w % 16 AS crop_w, (scaled_h % 16) // 2 AS top, (scaled_w % 16) // 2 AS "left" FROM y""")
def resize_plan(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "aif_images").where("image_h > 0 and image_w > 0")
    return i.select("image_id", *[x.alias(n) for n, x in numeric.resize_plan(c("image_h"), c("image_w"), 512).items()])


@R.query("SELECT CAST(s AS INTEGER) AS step, round(CASE WHEN s < 20 THEN (s + 1) / 20.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((s - 20) / 180.0, 1.0))) END, 9) AS rate FROM range(220) t(s)")
def cosine_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "chunk_limits").where("limit_id = 1").select(F.explode(F.sequence(F.lit(0), F.lit(219))).alias("step"))
    return s.select("step", F.round(numeric.cosine_schedule(c("step"), 20, 200, 0.1), 9).alias("rate"))


@R.query("""SELECT row_id, round(k_value * 512.0 / least(image_h, image_w), 5) AS k_512, round(least(abs(k_value * (1.0 / 4 - focus_disparity)) / 100, 1.0), 12) AS defocus FROM manifest WHERE least(image_h, image_w) > 0 AND image_h IS NOT NULL AND image_w IS NOT NULL AND CAST(k_value AS VARCHAR) <> 'nan' AND CAST(focus_disparity AS VARCHAR) <> 'nan'""")
def blur_conversions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("least(image_h, image_w) > 0 and image_h is not null and image_w is not null and k_value is not null and not isnan(k_value) and focus_disparity is not null and not isnan(focus_disparity)")
    z = numeric.signed_coc(F.lit(4.0), c("focus_disparity"), c("k_value"))
    return m.select("row_id", F.round(numeric.k_at_resolution(c("k_value"), c("image_h"), c("image_w"), 512), 5).alias("k_512"), F.round(numeric.defocus(z), 12).alias("defocus"))


@R.query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS customers, CAST(grouping_id(r_name, n_name) AS BIGINT) AS g, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_by_region(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.grouping_id("r_name", "n_name").alias("g"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@R.query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@R.query("""SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from quern.streaming.streams import windowed_counts

    return windowed_counts(table(spark, d, "events"), "6 hours").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@R.query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from quern.streaming.streams import sessions

    return sessions(table(spark, d, "events"), "user_id", "2 hours").select("user_id", "start", "n")


@R.query("SELECT user_id, event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS deviation FROM events")
def moving_deviation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(c("value") - F.avg("value").over(w), 6).alias("deviation"))
