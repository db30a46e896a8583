"""Queries of splits, samples, selections, contracts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.keys import K, bucket, hash_order, shard
from quern.operators import contract, gates, ranking, reconcile, release, sampling, select
from quern.plans.registry import Registry, table

R = Registry()
c = F.col

_BUCKET = "(('0x' || substr(sha256('{salt}:' || {x}), 1, 8))::BIGINT % 10000)"
_SIDE = f"CASE WHEN {_BUCKET.format(salt='v1', x='o_custkey')} < 2000 THEN 'val' ELSE 'train' END"


@R.query(f"SELECT o_orderkey, o_custkey, {_BUCKET.format(salt='v1', x='o_custkey')} AS bucket, {_SIDE} AS side FROM orders")
def split_by_group_hash(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.withColumns({"bucket": bucket("v1", c("o_custkey")), "side": sampling.scene_side(c("o_custkey"), 0.2, "v1")})


@R.query(f"""WITH r AS (SELECT o_custkey AS scene, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'val' ELSE {_SIDE} END AS side FROM orders),
s AS (SELECT DISTINCT o_custkey AS scene, {_SIDE} AS want FROM orders WHERE o_custkey % 50 <> 0),
b AS (SELECT scene, count(*) AS n, count(DISTINCT side) AS sides, count(*) - count(side) AS bare, list(DISTINCT side) FILTER (side IS NOT NULL) AS seen FROM r GROUP BY scene),
j AS (SELECT b.*, s.want, s.scene IS NOT NULL AS known FROM b LEFT JOIN s ON b.scene = s.scene)
SELECT 'both_sides' AS problem, scene, n FROM j WHERE scene IS NOT NULL AND sides > 1
UNION ALL SELECT 'no_scene', scene, n FROM j WHERE scene IS NULL
UNION ALL SELECT 'no_side', scene, bare FROM j WHERE bare > 0
UNION ALL SELECT 'not_in_split', scene, n FROM j WHERE scene IS NOT NULL AND NOT known
UNION ALL SELECT 'disagrees', scene, n FROM j WHERE known AND len(list_filter(seen, lambda x: x <> want)) > 0""")
def leak_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = sampling.scene_side(c("o_custkey"), 0.2, "v1")
    recorded = F.when(c("o_orderkey") % 97 == 0, None).when(c("o_orderkey") % 89 == 0, "val").otherwise(side)
    split = o.where("o_custkey % 50 <> 0").select(c("o_custkey").alias("scene_id")).distinct().withColumn("split", sampling.scene_side(c("scene_id"), 0.2, "v1"))
    return reconcile.leak_audit(o.select(c("o_custkey").alias("scene_id"), recorded.alias("split")), split)


@R.query("""WITH x AS (SELECT CASE WHEN scene_id IS NULL THEN NULL WHEN (('0x' || substr(sha256('m:' || scene_id), 1, 8))::BIGINT % 10000) < 1000 THEN 'val' ELSE 'train' END AS side, scene_id FROM manifest)
SELECT side, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM x GROUP BY side""")
def split_scene_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").withColumn("side", sampling.scene_side(c("scene_id"), 0.1, "m"))
    return m.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scene_id").alias("scenes"))


@R.query("""WITH x AS (SELECT CASE lower(trim(source_split)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'val' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' END AS side, source_split FROM aif_images)
SELECT side, count(*) AS n, CAST(count(*) FILTER (side IS NULL AND source_split IS NOT NULL) AS BIGINT) AS unknown FROM x GROUP BY side""")
def split_from_source(spark: SparkSession, d: str) -> DataFrame:
    names = {"train": "train", "training": "train", "val": "val", "validation": "val", "test": "test"}
    x = table(spark, d, "aif_images").withColumn("side", sampling.side_from_source(c("source_split"), names))
    return x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("side").isNull() & c("source_split").isNotNull()).alias("unknown"))


@R.query("SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16))::UBIGINT % 7 AS INTEGER) AS shard FROM customer")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", shard(c("c_custkey"), 7).alias("shard"))


@R.query("""WITH g AS (SELECT l_orderkey, count(*) AS n, sha256('pilot:' || l_orderkey) AS h FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, sum(n) OVER (ORDER BY h, l_orderkey ROWS UNBOUNDED PRECEDING) - n AS before FROM g)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM r WHERE before < 500) GROUP BY l_orderkey""")
def pilot_whole_groups(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pilot_groups(table(spark, d, "lineitem"), "l_orderkey", 500, "pilot").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT c_custkey, n_name FROM (SELECT c_custkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY sha256('s3:' || c_custkey), c_custkey) rn
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn <= 5""")
def stratified_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    return sampling.hash_sample(x, "c_custkey", 5, ["n_name"], "s3")


@R.query("SELECT image_id FROM aif_images ORDER BY sha256(CAST(image_id AS VARCHAR)), image_id LIMIT 64")
def smallest_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, "aif_images").select("image_id"), "image_id", 64)


@R.query("""WITH n AS (SELECT count(*) AS t FROM manifest), r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM manifest)
SELECT row_id, pos AS position FROM r, n WHERE pos % (t // 40) = 0 AND pos // (t // 40) < 40""")
def preflight_spread(spark: SparkSession, d: str) -> DataFrame:
    x = select.spread_rows(table(spark, d, "manifest").select("row_id"), [c("row_id").asc()], 40)
    return x.select("row_id", (c("position") - 1).alias("position"))


@R.query("""WITH n AS (SELECT count(*) AS t FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
want AS (SELECT CAST(floor(i * t / 33.0) AS BIGINT) AS pos FROM range(33) x(i), n) SELECT p_partkey, pos AS position FROM r WHERE pos IN (SELECT pos FROM want)""")
def stride_subset(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stride_rows(table(spark, d, "part").select("p_partkey"), [c("p_partkey").asc()], 33).select("p_partkey", "position")


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@R.query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) - 1 AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE n <= 3 OR rn IN (round_even(0 * (n - 1) / 2.0, 0), round_even(1 * (n - 1) / 2.0, 0), round_even(2 * (n - 1) / 2.0, 0))""")
def cap_levels_even(spark: SparkSession, d: str) -> DataFrame:
    x = select.cap_even(table(spark, d, "lineitem"), ["l_orderkey"], [c(k).asc() for k in _LINE_ORDER.split(", ")], 3)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@R.query("""WITH r AS (SELECT row_id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY k_value NULLS FIRST, row_id) - 1 AS rn, count(*) OVER (PARTITION BY scene_id) AS n FROM manifest WHERE scene_id IS NOT NULL)
SELECT row_id, scene_id FROM r WHERE n <= 4 OR rn IN (0, round_even((n - 1) / 3.0, 0), round_even(2 * (n - 1) / 3.0, 0), n - 1)""")
def cap_levels_by_measure(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("scene_id is not null").select("row_id", "scene_id", "k_value")
    return select.cap_even(m, ["scene_id"], [c("k_value").asc_nulls_first(), c("row_id").asc()], 4).select("row_id", "scene_id")


_DOCS = "SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS h FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL"


@R.query(f"""WITH x AS ({_DOCS}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, h || '-' || doc_id) AS rank_no FROM x WHERE n_chars >= 200)
SELECT source, doc_id, rank_no FROM r WHERE rank_no <= 7""")
def rank_cut_per_source(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)[0].select("source", "doc_id", "rank_no")


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "documents").where("n_chars is not null and source is not null")
    x = x.select("doc_id", "source", c("n_chars").cast("double").alias("score"), F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("-"), c("doc_id")).alias("tie"))
    return select.rank_and_cut(x, "source", "score", "tie", 200.0, 7)


@R.query(f"""WITH x AS ({_DOCS}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, h || '-' || doc_id) AS rank_no FROM x WHERE n_chars >= 200),
k AS (SELECT source, count(*) AS kept, CAST(min(n_chars) AS DOUBLE) AS cut_value FROM r WHERE rank_no <= 7 GROUP BY source)
SELECT source, count(*) AS candidates, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 6) AS p95,
  coalesce(any_value(kept), 0) AS kept, any_value(cut_value) AS cut_value FROM x LEFT JOIN k USING (source) GROUP BY source""")
def rank_cut_report(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d)[1]
    return r.select("source", "candidates", *[F.round(p, 6).alias(p) for p in ("p05", "p50", "p95")], "kept", "cut_value")


@R.query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk_rows(spark: SparkSession, d: str) -> DataFrame:
    return select.top_rows(table(spark, d, "documents").select("doc_id", c("n_chars").cast("double").alias("s"), "n_chars"), "s", 25, ["doc_id"]).drop("s")


@R.query("""WITH f AS (SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS s FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey FROM f ORDER BY s DESC, l_orderkey LIMIT 20) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey IN (FROM b)""")
def topk_groups_all_rows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return select.top_groups(x, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 20).drop("l_suppkey")


@R.query("SELECT h, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT sha256(text) AS h, doc_id FROM documents) GROUP BY h")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return select.dedup_first(x, ["h"], ["doc_id"])


@R.query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return select.dedup_last(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@R.query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_of FROM documents WHERE text IS NOT NULL QUALIFY doc_id <> first_of")
def dedup_reject(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return select.dedup_reject(x, "h", "doc_id", []).select("doc_id", "first_of")


@R.query("""WITH g AS (SELECT l_orderkey, max(l_linenumber) AS top, list(DISTINCT l_linenumber) AS have FROM lineitem WHERE l_linenumber >= 1 GROUP BY l_orderkey)
SELECT l_orderkey, top, list_filter(range(1, top + 1), lambda x: NOT list_contains(have, x))::INTEGER[] AS missing FROM g WHERE len(missing) > 0""")
def level_gaps(spark: SparkSession, d: str) -> DataFrame:
    return select.ordinal_gaps(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@R.query("SELECT row_id, round(abs(ln(k_value / max_coc)), 9) AS log_gap FROM manifest WHERE k_value > 0 AND NOT isnan(k_value) AND max_coc > 0 AND NOT isnan(max_coc) ORDER BY 2 DESC, row_id LIMIT 15")
def largest_divergences(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where(~F.isnan("k_value") & ~F.isnan("max_coc")).select("row_id", "k_value", "max_coc")
    return select.largest_ratio_gaps(m, "k_value", "max_coc", 15, ["row_id"]).select("row_id", F.round("log_gap", 9).alias("log_gap"))


@R.query("SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS levels FROM lineitem")
def group_count_on_rows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return x.join(x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("levels")), "l_orderkey")


_CUBE = """WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey IS NOT NULL), s AS (SELECT k, CAST(i AS INTEGER) AS draw_no FROM g, range(6) r(i)),
p AS (SELECT k, draw_no, sha256('lhs:' || k || ':p:' || draw_no) AS h FROM s), o AS (SELECT k, draw_no AS stratum, CAST(row_number() OVER (PARTITION BY k ORDER BY h) - 1 AS INTEGER) AS draw_no FROM p),
j AS (SELECT k, draw_no, stratum, ('0x' || substr(sha256('lhs:' || k || ':u:' || draw_no), 1, 8))::BIGINT / 4294967296.0 AS ju, ('0x' || substr(sha256('lhs:' || k || ':v:' || draw_no), 1, 8))::BIGINT / 4294967296.0 AS jv FROM o)
SELECT k AS c_custkey, draw_no, round((draw_no + ju) / 6, 9) AS u, round((stratum + jv) / 6, 9) AS v FROM j"""


@R.query(_CUBE)
def latin_hypercube_plan(spark: SparkSession, d: str) -> DataFrame:
    x = sampling.latin_hypercube(table(spark, d, "customer"), "c_custkey", 6, "lhs")
    return x.select("c_custkey", "draw_no", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@R.query("""WITH k AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS v FROM lineitem),
u AS (SELECT c_custkey, ('0x' || substr(sha256('draw:' || c_custkey), 1, 12))::BIGINT / 281474976710656.0 AS u FROM customer),
i AS (SELECT c_custkey, u, least(CAST(floor(u * 4) AS INTEGER), 3) AS s, v FROM u, k), r AS (SELECT c_custkey, v[s + 1] + (v[s + 2] - v[s + 1]) * (u - s * 0.25) / 0.25 AS raw, v FROM i)
SELECT c_custkey, round(raw, 6) AS raw, round(greatest(v[3] + 1.25 * (raw - v[3]), v[1] * 0.75), 6) AS widened FROM r""")
def inverse_cdf_draw(spark: SparkSession, d: str) -> DataFrame:
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    k = ranking.quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", {f"k{i}": q for i, q in enumerate(qs)})
    u = F.conv(F.substring(hash_order(c("c_custkey"), "draw"), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    x = table(spark, d, "customer").select("c_custkey", u.alias("u")).join(F.broadcast(k))
    q, v = F.array(*[F.lit(a) for a in qs]), F.array(*[c(f"k{i}") for i in range(5)])
    return x.select("c_custkey", F.round(sampling.interpolate(q, v, c("u")), 6).alias("raw"), F.round(sampling.widened_draw(q, v, c("u"))[0], 6).alias("widened"))


@R.query("""WITH n AS (SELECT route, count(*) AS n FROM manifest WHERE route IN ('a', 'b', 'c') GROUP BY route)
SELECT row_id, route, round(CASE route WHEN 'a' THEN 0.2 WHEN 'b' THEN 0.3 ELSE 0.5 END / n, 12) AS weight FROM manifest JOIN n USING (route)""")
def route_weights(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("route in ('a', 'b', 'c')").select("row_id", "route")
    return sampling.route_weights(m, "route", {"a": 0.2, "b": 0.3, "c": 0.5}).withColumn("weight", F.round("weight", 12))


@R.query("""WITH n AS (SELECT route, count(*) AS n FROM manifest WHERE route IN ('a', 'b', 'c') GROUP BY route)
SELECT row_id, route, round(CASE route WHEN 'a' THEN 0.4 WHEN 'b' THEN 0.6 * 1.0 / 4.0 ELSE 0.6 * 3.0 / 4.0 END / n, 12) AS weight FROM manifest JOIN n USING (route)""")
def replay_weights(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("route in ('a', 'b', 'c')").select("row_id", "route")
    return sampling.replay_weights(m, "route", "a", 0.4, {"b": 1.0, "c": 3.0}).withColumn("weight", F.round("weight", 12))


@R.query("""WITH r AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - p_size AS lo, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS hi FROM part WHERE p_size > 0),
t AS (SELECT sum(p_size) AS t FROM part WHERE p_size > 0), u AS (SELECT i AS draw_no, ('0x' || substr(sha256('wd:' || i), 1, 12))::BIGINT / 281474976710656.0 * t AS x FROM range((SELECT count(*) FROM part)) r(i), t)
SELECT draw_no, p_partkey FROM u JOIN r ON x >= lo AND x < hi""")
def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as the table has rows."""
    part = table(spark, d, "part")
    return sampling.weighted_draws(part, "p_partkey", "p_size", part.count(), "wd")


_RULES = {"missing_sample_id": "sample_id IS NULL OR trim(sample_id) = ''", "missing_scene_id": "scene_id IS NULL OR trim(scene_id) = ''", "missing_route": "route IS NULL OR trim(route) = ''", "missing_source_dataset": "source_dataset IS NULL OR trim(source_dataset) = ''",
          "not_positive_k_value": "k_value IS NULL OR isnan(k_value) OR isinf(k_value) OR k_value <= 0", "not_positive_focus_disparity": "focus_disparity IS NULL OR isnan(focus_disparity) OR isinf(focus_disparity) OR focus_disparity <= 0",
          "unknown_k_source": "k_source NOT IN ('eq5_ssim_sweep', 'eq3_exif', 'sampled_from_bc')", "unknown_focus_source": "focus_source NOT IN ('birefnet', 'birefnet_refined', 'retention_only', 'sampled')",
          "version": "control_version IS NULL OR control_version NOT IN ('ctl-1.4')", "resolution": "NOT coalesce(image_h > 0 AND image_w > 0, false)", "depth_resolution": "depth_h > image_h OR depth_w > image_w",
          "censored_but_valid": "is_k_censored AND is_valid_for_control", "sampled_but_refined": "focus_source = 'sampled' AND focus_was_refined"}
_VOCABULARY = {"k_source": ["eq5_ssim_sweep", "eq3_exif", "sampled_from_bc"], "focus_source": ["birefnet", "birefnet_refined", "retention_only", "sampled"]}
_VIOLATED = "list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _RULES.items()) + "], lambda x: x IS NOT NULL)"


@R.query(f"SELECT row_id, {_VIOLATED} AS violations FROM manifest WHERE len({_VIOLATED}) > 0")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").withColumn("violations", contract.violations(release.manifest_rules(["ctl-1.4"], _VOCABULARY)))
    return m.where(F.size("violations") > 0).select("row_id", "violations")


@R.query(f"SELECT v AS rule, count(*) AS n FROM (SELECT unnest({_VIOLATED}) AS v FROM manifest) GROUP BY v")
def contract_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select(F.explode(contract.violations(release.manifest_rules(["ctl-1.4"], _VOCABULARY))).alias("rule"))
    return m.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_CASCADE = """CASE WHEN control_version IS NULL OR control_version <> 'ctl-1.4' THEN 'version' WHEN scene_id IS NULL THEN 'no_scene' WHEN is_k_censored THEN 'censored' WHEN NOT is_valid_for_control THEN 'not_valid'
  WHEN k_value IS NULL OR isnan(k_value) OR k_value <= 0 THEN 'k' WHEN calibration_ssim < 0.85 THEN 'ssim' WHEN focus_agreement < 0.3 THEN 'agreement' END"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        contract.Rule("version", ~F.coalesce(c("control_version") == "ctl-1.4", F.lit(False)), "control_version", True),
        contract.Rule("no_scene", c("scene_id").isNull(), "scene_id", True),
        contract.Rule("censored", c("is_k_censored"), "is_k_censored"),
        contract.Rule("not_valid", ~c("is_valid_for_control"), "is_valid_for_control"),
        contract.Rule("k", ~contract.finite(c("k_value")) | (c("k_value") <= 0), "k_value"),
        contract.Rule("ssim", ~F.isnan("calibration_ssim") & (c("calibration_ssim") < 0.85), "calibration_ssim"),
        contract.Rule("agreement", ~F.isnan("focus_agreement") & (c("focus_agreement") < 0.3), "focus_agreement"),
        contract.Rule("absent_column", F.lit(True), "focus_entropy"),
    ]
    return contract.drop_cascade(table(spark, d, "manifest"), rules)


@R.query(f"SELECT row_id, {_CASCADE} AS drop_reason FROM manifest")
def drop_reason_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).select("row_id", "drop_reason")


@R.query(f"WITH x AS (SELECT {_CASCADE} AS drop_reason FROM manifest) SELECT drop_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 9) AS share FROM x WHERE drop_reason IS NOT NULL GROUP BY 1")
def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    return contract.histogram(_cascade(spark, d), "drop_reason").withColumn("share", F.round("share", 9))


@R.query("""WITH m AS (SELECT source_dataset, coalesce(bool_or(calibration_ssim > 0 AND NOT isnan(calibration_ssim)), false) AS measured FROM manifest WHERE source_dataset IS NOT NULL GROUP BY 1)
SELECT row_id FROM manifest JOIN m USING (source_dataset) WHERE NOT measured OR coalesce(calibration_ssim >= 0.9 AND NOT isnan(calibration_ssim) AND k_value > 0, false)""")
def keep_calibrated(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("source_dataset is not null").select("row_id", "source_dataset", "calibration_ssim", "k_value")
    return contract.keep_calibrated(m, "source_dataset", "calibration_ssim", 0.9, "k_value").select("row_id")


@R.query("""SELECT source_dataset, count(*) AS rows FROM manifest WHERE source_dataset IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (calibration_ssim > 0 AND NOT isnan(calibration_ssim)) > 0 AND count(*) FILTER (calibration_ssim >= 0.999 AND NOT isnan(calibration_ssim) AND k_value > 0) = 0""")
def emptied_sources(spark: SparkSession, d: str) -> DataFrame:
    return contract.emptied_sources(table(spark, d, "manifest"), "source_dataset", "calibration_ssim", 0.999, "k_value")


@R.query("""WITH r AS (SELECT *, coalesce(calibration_ssim >= 0.9 AND NOT isnan(calibration_ssim), false) AS ok FROM manifest), c AS (SELECT *, count(*) FILTER (ok) OVER (ORDER BY row_id) AS upto FROM r)
SELECT row_id, upto AS accepted FROM c WHERE ok AND upto <= 500""")
def limit_by_accepted(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce((c("calibration_ssim") >= 0.9) & ~F.isnan("calibration_ssim"), F.lit(False))
    return select.limit_accepted(table(spark, d, "manifest").select("row_id", "calibration_ssim"), ok, ["row_id"], 500).select("row_id", "accepted")


@R.query("""WITH a AS (SELECT DISTINCT regexp_extract(depth_ref, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM manifest WHERE depth_ref IS NOT NULL), b AS (SELECT DISTINCT scene_id || '.npz' AS f FROM depth_encodings WHERE scene_id IS NOT NULL)
SELECT stem, f AS other FROM a JOIN (SELECT f, regexp_extract(f, '([^/]+?)(\\.[^./]*)?$', 1) AS s FROM b) ON s = stem""")
def pairs_by_stem(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "manifest").where("depth_ref is not null").select("depth_ref").distinct()
    b = table(spark, d, "depth_encodings").where("scene_id is not null").select(F.concat("scene_id", F.lit(".npz")).alias("f")).distinct()
    return select.pair_by_stem(a, "depth_ref", b, "f").select("stem", c("f").alias("other")).distinct()


@R.query("""SELECT doc_id, CASE WHEN contains(lower(text), 'blur') THEN 'blur' WHEN contains(lower(text), 'depth') THEN 'depth' WHEN contains(lower(text), 'scene') THEN 'scene' END AS bench FROM documents
WHERE (contains(text, 'a') OR contains(text, 'e')) AND NOT contains(text, 'zz')""")
def ordered_bench(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where(text.chosen(c("text"), ["a", "e"], ["zz"]))
    return x.select("doc_id", text.first_substring(F.lower("text"), {"blur": "blur", "depth": "depth", "scene": "scene"}).alias("bench"))


@R.query("""SELECT row_id, '{"image_h":' || coalesce(image_h::VARCHAR, 'null') || ',"route":' || coalesce('"' || route || '"', 'null') || ',"valid":' || coalesce(is_valid_for_control::VARCHAR, 'null') || '}' AS doc FROM manifest""")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("row_id", text.metadata_json({"valid": c("is_valid_for_control"), "route": c("route"), "image_h": c("image_h")}).alias("doc"))


@R.query("""SELECT depth_backend, count(*) AS n FROM manifest WHERE depth_backend IS NOT NULL AND depth_backend NOT IN ('depth_pro', 'metric_v2') GROUP BY 1""")
def unknown_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("depth_pro",), ("metric_v2",)], "word string")
    return contract.unknown_values(table(spark, d, "manifest"), "depth_backend", words, "word")


def _gates() -> dict[str, F.Column]:
    return {
        "ssim": gates.gate(c("calibration_ssim"), 0.85, applicable=c("route") == "c"),
        "retention": gates.gate(c("focus_retention_in_region"), 0.3),
        "area_max": gates.gate(c("focus_region_area_ratio"), 0.4, False),
        "agreement": gates.gate(c("focus_agreement")),
    }


_NF = "({0} IS NULL OR CAST({0} AS VARCHAR) IN ('nan', 'inf', '-inf'))"  # as text: this is not folded by statistics that ignore NaN
_PASS = {"ssim": f"CASE WHEN NOT coalesce(route = 'c', false) THEN true WHEN {_NF.format('calibration_ssim')} THEN false ELSE calibration_ssim >= 0.85 END",
         "retention": f"CASE WHEN {_NF.format('focus_retention_in_region')} THEN false ELSE focus_retention_in_region >= 0.3 END",
         "area_max": f"CASE WHEN {_NF.format('focus_region_area_ratio')} THEN false ELSE focus_region_area_ratio <= 0.4 END", "agreement": f"NOT {_NF.format('focus_agreement')}"}


@R.query("SELECT gate, count(*) AS n, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS blocked FROM (SELECT unnest([" + ", ".join(f"{{'gate': '{n}', 'ok': {e}}}" for n, e in _PASS.items()) + "], recursive := true) FROM manifest) GROUP BY gate")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select(F.explode(gates.report(_gates())).alias("gate", "g"))
    return m.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_if(~c("g.passed")).alias("blocked"))


@R.query("SELECT row_id, CASE " + " ".join(f"WHEN NOT ({e}) THEN 'gate_{n}'" for n, e in _PASS.items()) + " END AS slug FROM manifest WHERE slug IS NOT NULL")
def gate_first_block(spark: SparkSession, d: str) -> DataFrame:
    g = _gates()
    return table(spark, d, "manifest").select("row_id", gates.first_block(g, {n: f"gate_{n}" for n in g}).alias("slug")).where("slug is not null")


@R.query("""WITH x AS (SELECT row_id, CASE WHEN focus_disparity > 0 THEN 1.0 / focus_disparity ELSE 'infinity'::DOUBLE END AS z FROM manifest)
SELECT row_id, CASE WHEN z IS NULL OR isnan(z) OR isinf(z) OR z < 0.5 THEN 'focus_depth_m_min' WHEN z > 4 THEN 'focus_depth_m_max' END AS slug FROM x WHERE slug IS NOT NULL""")
def focus_depth_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("row_id", gates.first_block(gates.focus_depth(c("focus_disparity"), 0.5, 4.0)).alias("slug")).where("slug is not null")


_NAME = r"^([A-Za-z]+)_([A-Za-z_]+)_f_([0-9]+)_level_([0-9]+)_(aligned|misaligned|shift_([0-9]+(?:\.[0-9]+)?)px)$"


@R.query(rf"""WITH x AS (SELECT row_id, source_sample_id AS s, coalesce(regexp_full_match(source_sample_id, '{_NAME}') AND TRY_CAST(regexp_extract(source_sample_id, '{_NAME}', 4) AS INTEGER) >= 1, false) AS valid FROM manifest)
SELECT row_id, valid, CASE WHEN valid THEN regexp_extract(s, '{_NAME}', 1) END AS prefix, CASE WHEN valid THEN regexp_extract(s, '{_NAME}', 2) END AS split_name, CASE WHEN valid THEN TRY_CAST(regexp_extract(s, '{_NAME}', 3) AS BIGINT) END AS scene_no,
  CASE WHEN valid THEN TRY_CAST(regexp_extract(s, '{_NAME}', 4) AS INTEGER) END AS level, CASE WHEN valid THEN regexp_extract(regexp_extract(s, '{_NAME}', 5), '^[a-z]+') END AS alignment,
  CASE WHEN valid THEN TRY_CAST(regexp_extract(s, '{_NAME}', 6) AS DOUBLE) END AS shift_px FROM x""")
def name_grammar(spark: SparkSession, d: str) -> DataFrame:
    p = text.parse_name("source_sample_id")
    return table(spark, d, "manifest").select("row_id", *[p[k].alias("split_name" if k == "split" else k) for k in p])


@R.query(r"""SELECT image_id, CASE WHEN aif_ref IS NULL THEN NULL WHEN regexp_full_match(aif_ref, '[^#]+#[^\[\]]+\[[0-9]+\]\..+') THEN 'row' WHEN contains(aif_ref, '#') OR trim(aif_ref) = '' THEN 'malformed' WHEN contains(aif_ref, '/') THEN 'path' ELSE 'column' END AS kind,
  CASE WHEN kind = 'row' THEN regexp_extract(aif_ref, '^([^#]+)#', 1) END AS repo, CASE WHEN kind = 'row' THEN TRY_CAST(regexp_extract(aif_ref, '\[([0-9]+)\]', 1) AS BIGINT) END AS row_no,
  CASE WHEN kind = 'row' THEN regexp_extract(aif_ref, '\]\.(.+)$', 1) WHEN kind = 'column' THEN aif_ref END AS column_name FROM aif_images""")
def reference_grammar(spark: SparkSession, d: str) -> DataFrame:
    p = text.parse_reference("aif_ref")
    return table(spark, d, "aif_images").select("image_id", *[p[k].alias(k) for k in ("kind", "repo", "row_no", "column_name")])


@R.query(r"""SELECT scene, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(source_sample_id, '_k[0-9]+_d[0-9]+$', ''), '_level_[0-9]+.*$', '', 's'), '_(aligned|misaligned|shift_[0-9.]+px)$', '') AS scene FROM manifest) GROUP BY scene""")
def scene_key_strategies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").groupBy(text.scene_of_image(c("source_sample_id")).alias("scene")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT c_mktsegment, upper(substr(c_mktsegment, 1, 1)) AS initial, count(*) AS n FROM customer GROUP BY ALL""")
def segment_initials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment", F.upper(F.substring("c_mktsegment", 1, 1)).alias("initial")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH l AS (SELECT * FROM (VALUES ('a_', 'route a'), ('b_', 'route b'), ('c_', 'route c'), ('c_fp', 'pairs'), ('c_fp_s', 'pair scenes')) t(p, l)),
n AS (SELECT DISTINCT sample_id FROM manifest WHERE sample_id IS NOT NULL), h AS (SELECT sample_id, arg_max(l, length(p)) AS label FROM n JOIN l ON starts_with(sample_id, p) GROUP BY 1)
SELECT label, count(*) AS n FROM manifest LEFT JOIN h USING (sample_id) GROUP BY label""")
def longest_prefix_label(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("a_", "route a"), ("b_", "route b"), ("c_", "route c"), ("c_fp", "pairs"), ("c_fp_s", "pair scenes")], "p string, l string")
    return text.longest_label(table(spark, d, "manifest").select("sample_id"), "sample_id", labels, "p", "l").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH ids AS (SELECT DISTINCT scene_id AS i FROM aif_images WHERE scene_id IS NOT NULL), f AS (SELECT DISTINCT scene_id || '_depth_v2' AS file_name FROM depth_encodings WHERE scene_id IS NOT NULL),
h AS (SELECT file_name, arg_max(i, length(i)) AS known_id FROM f JOIN ids ON file_name = i OR starts_with(file_name, i || '_') GROUP BY 1) SELECT file_name, known_id FROM f LEFT JOIN h USING (file_name)""")
def longest_known_prefix(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "depth_encodings").where("scene_id is not null").select(F.concat("scene_id", F.lit("_depth_v2")).alias("file_name")).distinct()
    return text.known_prefix(files, "file_name", table(spark, d, "aif_images"), "scene_id")


@R.query(r"""SELECT row_id, regexp_full_match(scene_id, '[A-Za-z0-9_-][A-Za-z0-9._-]*') IS TRUE AS safe, 'depth/' || scene_id || '.png' AS path, sample_id || '_' || route AS surrogate FROM manifest""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    return m.select("row_id", text.file_safe(c("scene_id")).alias("safe"), F.when(c("scene_id").isNotNull(), text.depth_path(c("scene_id"), c("sample_id"), F.lit("per_scene"))).alias("path"), text.sample_id(c("sample_id"), c("route")).alias("surrogate"))


@R.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'none') AS first_of, sha256(props) AS digest FROM events""")
def json_nested_fetch(spark: SparkSession, d: str) -> DataFrame:
    p = c("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").try_cast("int").alias("k"), F.coalesce(text.first_of(p, "$.missing", "$.k"), F.lit("none")).alias("first_of"), F.sha2(p, 256).alias("digest"))


@R.query("""SELECT regexp_replace(lower(source_dataset), '[^a-z0-9]', '', 'g') AS source_key, count(*) AS n, count(DISTINCT source_dataset) AS spellings FROM aif_images GROUP BY 1""")
def spelling_census(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aif_images").groupBy(K("source_dataset").alias("source_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_dataset").alias("spellings"))
