"""Queries of reconciliation, joins, sources and the release validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keys import K, bucket
from quern.operators import audits, reconcile, release
from quern.plans.registry import Registry, table
from quern.sources import readers, writers

R = Registry()
c = F.col


@R.query("""WITH a AS (SELECT DISTINCT 'depth/' || scene_id || '.png' AS f FROM depth_encodings WHERE scene_id IS NOT NULL), b AS (SELECT DISTINCT depth_ref AS f FROM manifest WHERE depth_ref IS NOT NULL)
SELECT coalesce(a.f, b.f) AS depth_ref, CASE WHEN b.f IS NULL THEN 'missing' WHEN a.f IS NULL THEN 'extra' ELSE 'same' END AS state FROM a FULL JOIN b ON a.f = b.f""")
def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "depth_encodings").select(F.concat(F.lit("depth/"), "scene_id", F.lit(".png")).alias("depth_ref"), F.lit(1).alias("s")).distinct()
    b = table(spark, d, "manifest").select("depth_ref", F.lit(1).alias("s")).distinct()
    return reconcile.compare_listings(a, b, "depth_ref", "s")


@R.query("SELECT image_id, sha256 FROM aif_images WHERE sha256 IS NULL OR sha256 NOT IN (SELECT sha256 FROM sharpness WHERE sha256 IS NOT NULL)")
def digest_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.absent_by_content(table(spark, d, "aif_images").select("image_id", "sha256"), table(spark, d, "sharpness"), "sha256").select("image_id", "sha256")


@R.query("""WITH r AS (SELECT image_id + 0 AS i, image_h, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY measurement_id) rn FROM sharpness WHERE image_id IS NOT NULL) WHERE rn = 1)
SELECT image_id, CASE WHEN r.i IS NULL THEN 'absent' WHEN r.sha256 IS NULL THEN 'no_remote_digest' WHEN a.image_h IS DISTINCT FROM r.image_h THEN 'size_differs' WHEN a.sha256 IS DISTINCT FROM r.sha256 THEN 'digest_differs' ELSE 'identical' END AS state
FROM aif_images a LEFT JOIN r ON a.image_id = r.i""")
def classify_remote(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sharpness").where("image_id is not null").groupBy("image_id").agg(F.min_by(F.struct("image_h", "sha256"), "measurement_id").alias("x")).select("image_id", "x.*")
    return reconcile.classify_local(table(spark, d, "aif_images").select("image_id", "image_h", "sha256"), r, "image_id", "image_h", "sha256").select("image_id", "state")


@R.query("""WITH p AS (SELECT scene_id, count(*) AS n FROM manifest WHERE scene_id IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS r FROM p),
b AS (SELECT DISTINCT coalesce(lang, 'none') AS bench, scene_id FROM documents WHERE scene_id IS NOT NULL), e AS (FROM b UNION SELECT '*', scene_id FROM b)
SELECT bench, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows_hit, round(count(*) / any_value(k), 9) AS key_share, round(sum(n) / any_value(r), 9) AS row_share FROM e JOIN p USING (scene_id), t GROUP BY bench""")
def contamination_semi_join(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("bench"), "scene_id")
    x = reconcile.overlap_shares(table(spark, d, "manifest"), "scene_id", probes, "bench")
    return x.withColumns({k: F.round(k, 9) for k in ("key_share", "row_share")})


@R.query("SELECT scene_id, list_sort(list(DISTINCT split)) AS groups FROM manifest WHERE scene_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def overlap_across_splits(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.spread_over(table(spark, d, "manifest"), "scene_id", "split")


@R.query("""SELECT n_nationkey, r_regionkey FROM nation, region WHERE NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_nationkey = nation.n_nationkey AND x.n_regionkey = region.r_regionkey)""")
def grid_minus_done(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    done = n.select("n_nationkey", c("n_regionkey").alias("r_regionkey"))
    return reconcile.grid_minus_done(n.select("n_nationkey"), table(spark, d, "region").select("r_regionkey"), done)


@R.query("""WITH u AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'val' ELSE 'train' END FROM orders WHERE o_orderkey % 2 = 1)
SELECT k AS o_custkey, min(v) AS side, count(DISTINCT v) > 1 AS conflict FROM u GROUP BY k""")
def split_union_conflict(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    a = o.where("o_orderkey % 2 = 0").withColumn("side", F.when(c("o_orderkey") % 5 == 0, "val").otherwise("train"))
    b = o.where("o_orderkey % 2 = 1").withColumn("side", F.when(c("o_custkey") % 7 == 0, "val").otherwise("train"))
    return reconcile.union_with_conflicts(a, b, "o_custkey", "side")


@R.query("""WITH m AS (SELECT sample_id, any_value(scene_id) AS scene_id, min(k_value) AS k FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1), g AS (SELECT sample_id, min(k_value) AS k, min(image_h) AS image_h FROM generated_images WHERE sample_id IS NOT NULL GROUP BY 1)
SELECT coalesce(m.sample_id, g.sample_id) AS sample_id, coalesce(m.k, g.k) AS k, g.image_h FROM m FULL JOIN g ON m.sample_id = g.sample_id""")
def prefer_left_merge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("sample_id is not null").groupBy("sample_id").agg(F.min("k_value").alias("k"))
    g = table(spark, d, "generated_images").where("sample_id is not null").groupBy("sample_id").agg(F.min("k_value").alias("k"), F.min("image_h").alias("image_h"))
    return reconcile.prefer_left(m, g, "sample_id")


@R.query("""WITH s AS (SELECT DISTINCT scene_id AS i, CASE WHEN (('0x' || substr(sha256('v:' || scene_id), 1, 8))::BIGINT % 10000) < 1000 THEN 'val' ELSE 'train' END AS want FROM manifest WHERE scene_id IS NOT NULL)
SELECT split, want, count(*) AS n FROM manifest LEFT JOIN s ON scene_id = i WHERE split IS DISTINCT FROM want GROUP BY ALL""")
def recorded_against_split(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    s = m.where("scene_id is not null").select("scene_id").distinct().withColumn("want", F.when(bucket("v", c("scene_id")) < 1000, "val").otherwise("train"))
    return readers.with_side(m.select("scene_id", "split"), s).where(~c("split").eqNullSafe(c("want"))).groupBy("split", "want").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH l AS (SELECT image_id, arg_max(laplacian_variance, measurement_id) AS v FROM sharpness WHERE image_id IS NOT NULL AND sha256 IS NOT NULL AND laplacian_variance IS NOT NULL GROUP BY 1)
SELECT image_id, v AS laplacian_variance FROM aif_images JOIN l USING (image_id)""")
def lookup_last_complete(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sharpness").select("image_id", "sha256", "laplacian_variance", "measurement_id")
    t = reconcile.last_complete(s, "image_id", ["sha256", "laplacian_variance"], c("measurement_id"))
    return table(spark, d, "aif_images").select("image_id").join(t, "image_id").select("image_id", "laplacian_variance")


@R.query("""WITH t AS (SELECT scene_id AS k, min(disparity_min) AS v FROM depth_encodings WHERE scene_id IS NOT NULL GROUP BY 1 UNION ALL SELECT sample_id, min(focus_disparity) FROM generated_images WHERE sample_id IS NOT NULL GROUP BY 1)
SELECT row_id, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'sample_id' WHEN b.v IS NOT NULL THEN 'scene_id' END AS found_by FROM manifest m LEFT JOIN t a ON m.sample_id = a.k LEFT JOIN t b ON m.scene_id = b.k""")
def two_level_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "depth_encodings").where("scene_id is not null").groupBy(c("scene_id").alias("key")).agg(F.min("disparity_min").alias("v"))
    b = table(spark, d, "generated_images").where("sample_id is not null").groupBy(c("sample_id").alias("key")).agg(F.min("focus_disparity").alias("v"))
    m = table(spark, d, "manifest").select("row_id", "sample_id", "scene_id")
    return reconcile.two_level_lookup(m, a.unionByName(b), "sample_id", "scene_id", "v").select("row_id", "value", "found_by")


@R.query("""WITH s AS (SELECT scene_id, max(disparity_max) AS top FROM depth_encodings WHERE scene_id IS NOT NULL GROUP BY 1)
SELECT row_id, route, top FROM manifest JOIN s USING (scene_id) WHERE route = 'b' UNION ALL SELECT row_id, route, NULL FROM manifest WHERE route IS DISTINCT FROM 'b' AND coalesce(route <> 'b', true)""")
def merge_scalars(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "depth_encodings").where("scene_id is not null").groupBy("scene_id").agg(F.max("disparity_max").alias("top"))
    return reconcile.merge_scalars(table(spark, d, "manifest").select("row_id", "route", "scene_id"), s, "route", "b", "scene_id").select("row_id", "route", "top")


@R.query("""WITH e AS (SELECT scene_id, min(disparity_min) AS lo, max(disparity_max) AS hi FROM depth_encodings WHERE scene_id IS NOT NULL GROUP BY 1)
SELECT row_id, focus_disparity BETWEEN lo AND hi AS inside FROM manifest LEFT JOIN e USING (scene_id)""")
def containment_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "depth_encodings").where("scene_id is not null").groupBy("scene_id").agg(F.min("disparity_min").alias("lo"), F.max("disparity_max").alias("hi"))
    return table(spark, d, "manifest").join(e, "scene_id", "left").select("row_id", c("focus_disparity").between(c("lo"), c("hi")).alias("inside"))


@R.query("""SELECT coalesce(a.route, b.route) AS route, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM (SELECT route, count(*) AS n FROM manifest GROUP BY 1) a
FULL JOIN (SELECT route, count(*) AS n FROM generated_images GROUP BY 1) b ON a.route IS NOT DISTINCT FROM b.route""")
def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile_counts(table(spark, d, "manifest"), table(spark, d, "generated_images"), "route")


@R.query("SELECT DISTINCT mask_source FROM manifest WHERE mask_source NOT IN ('manual', 'depth_band')")
def beyond_requested_variant(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.beyond_requested(table(spark, d, "manifest"), "mask_source", ["manual", "depth_band"])


@R.query("""WITH a AS (SELECT sample_id AS k, max(k_value) AS v FROM manifest WHERE sample_id IS NOT NULL AND (k_value IS NULL OR NOT isnan(k_value)) GROUP BY 1), b AS (SELECT sample_id AS k, max(k_value) AS v FROM generated_images WHERE sample_id IS NOT NULL AND (k_value IS NULL OR NOT isnan(k_value)) GROUP BY 1)
SELECT coalesce(a.k, b.k) AS sample_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v OR abs(b.v - a.v) <= 0.001 THEN 'equal' ELSE 'changed' END AS state, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t: table(spark, d, t).where("sample_id is not null and not isnan(k_value)").groupBy("sample_id").agg(F.max("k_value").alias("v"))
    return reconcile.keyed_diff(per("manifest"), per("generated_images"), "sample_id", "v", 0.001).withColumn("delta", F.round("delta", 6))


@R.query("""WITH s AS (SELECT DISTINCT scene_id FROM depth_encodings WHERE scene_id IS NOT NULL) SELECT image_id, CASE WHEN s.scene_id IS NULL THEN 'source_metadata_missing' ELSE 'ok' END AS status FROM aif_images a LEFT JOIN s ON a.scene_id = s.scene_id""")
def join_with_status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "depth_encodings").where("scene_id is not null").select("scene_id").distinct()
    return reconcile.joined_or_reason(table(spark, d, "aif_images").select("image_id", "scene_id"), s, "scene_id", "source_metadata_missing").select("image_id", "status")


@R.query("""WITH m AS (SELECT sample_id, any_value(route) AS r FROM manifest GROUP BY 1), g AS (SELECT CASE route WHEN 'a' THEN scene_id ELSE sample_id END AS k FROM generated_images)
SELECT count(*) AS n, CAST(count(*) FILTER (k IS NULL) AS BIGINT) AS without_key, count(DISTINCT k) AS keys FROM g""")
def route_dependent_key(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(c("route") == "a", c("scene_id")).otherwise(c("sample_id"))
    return table(spark, d, "generated_images").select(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("k").isNull()).alias("without_key"), F.countDistinct("k").alias("keys"))


@R.query("""WITH g AS (SELECT DISTINCT sample_id AS k FROM generated_images WHERE bokeh_path IS NOT NULL AND sample_id IS NOT NULL), s AS (SELECT scene_id AS k, min(sha256) AS sha256 FROM depth_encodings WHERE scene_id IS NOT NULL GROUP BY 1),
a AS (SELECT source_sample_id AS k, min(sha256) AS sha256 FROM aif_images WHERE source_sample_id IS NOT NULL GROUP BY 1)
SELECT row_id, CASE WHEN g.k IS NOT NULL THEN 'generated' WHEN s.k IS NOT NULL OR s2.k IS NOT NULL THEN 'source' WHEN a.k IS NOT NULL THEN 'mirror' ELSE 'none' END AS origin,
  CASE WHEN g.k IS NOT NULL THEN NULL WHEN s.k IS NOT NULL THEN s.sha256 WHEN s2.k IS NOT NULL THEN s2.sha256 ELSE a.sha256 END AS expected_sha256
FROM manifest m LEFT JOIN g ON m.sample_id = g.k LEFT JOIN s ON m.sample_id = s.k LEFT JOIN s s2 ON m.scene_id = s2.k LEFT JOIN a ON m.source_sample_id = a.k""")
def resolve_pixels(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generated_images").where("bokeh_path is not null and sample_id is not null").groupBy(c("sample_id").alias("key")).agg(F.lit(None).cast("string").alias("sha256"))
    s = table(spark, d, "depth_encodings").where("scene_id is not null").groupBy(c("scene_id").alias("key")).agg(F.min("sha256").alias("sha256"))
    a = table(spark, d, "aif_images").where("source_sample_id is not null").groupBy(c("source_sample_id").alias("key")).agg(F.min("sha256").alias("sha256"))
    m = table(spark, d, "manifest").select("row_id", "sample_id", "scene_id", "source_sample_id")
    return readers.resolve_pixels(m, g, s, a).select("row_id", "origin", "expected_sha256")


@R.query("""SELECT scene_id, source_dataset, 'aif' AS source FROM aif_images UNION ALL SELECT scene_id, source_dataset, 'manifest' FROM manifest""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    t = {"aif": table(spark, d, "aif_images"), "manifest": table(spark, d, "manifest")}
    return readers.union_sources(t, ["scene_id"], ["scene_id", "source_dataset", "k_value"])


@R.query("SELECT row_id, sample_id FROM manifest WHERE sample_id IS NULL OR sample_id NOT IN (SELECT sample_id FROM generated_images WHERE sample_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return readers.not_done(table(spark, d, "manifest").select("row_id", "sample_id"), table(spark, d, "generated_images"), "sample_id").select("row_id", "sample_id")


@R.query("""SELECT scene_id, count(DISTINCT sha256) AS versions FROM depth_encodings WHERE scene_id IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sha256) > 1""")
def conflicting_payloads(spark: SparkSession, d: str) -> DataFrame:
    return writers.conflicting_payloads(table(spark, d, "depth_encodings"), "scene_id", "sha256")


@R.query("SELECT count(*) AS samples, count(DISTINCT scene_id) AS scenes, CAST(count(*) * 500000 + count(DISTINCT scene_id) * 2000000 AS BIGINT) AS bytes_needed FROM manifest")
def disk_budget(spark: SparkSession, d: str) -> DataFrame:
    return writers.disk_budget(table(spark, d, "manifest"), "scene_id", 500_000, 2_000_000)


@R.query("""WITH u AS (SELECT sample_id, min(depth_ref) AS target FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1), f AS (SELECT sample_id, max(CASE WHEN bokeh_path IS NOT NULL THEN 1 ELSE 0 END) AS bokeh, max(CASE WHEN depth_sha256 IS NOT NULL THEN 1 ELSE 0 END) AS depth FROM generated_images GROUP BY 1),
n AS (SELECT target, count(*) AS n FROM u GROUP BY 1) SELECT sample_id, CASE WHEN coalesce(bokeh, 0) = 0 THEN 'missing_bokeh' WHEN coalesce(depth, 0) = 0 THEN 'missing_depth' WHEN n > 1 THEN 'target_collision' ELSE 'ok' END AS state
FROM u LEFT JOIN f USING (sample_id) LEFT JOIN n USING (target)""")
def publish_manifest(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "manifest").where("sample_id is not null").groupBy("sample_id").agg(F.min("depth_ref").alias("target"))
    kinds = F.explode(F.array_compact(F.array(F.when(c("bokeh_path").isNotNull(), "bokeh"), F.when(c("depth_sha256").isNotNull(), "depth"))))
    f = table(spark, d, "generated_images").where("sample_id is not null").select("sample_id", kinds.alias("kind"))
    return audits.publishable(u, f, "sample_id", "kind", ["bokeh", "depth"], "target").select("sample_id", "state")


@R.query("""WITH e AS (SELECT DISTINCT route, sample_id FROM manifest WHERE sample_id IS NOT NULL), d AS (SELECT DISTINCT route, sample_id FROM generated_images)
SELECT e.route, count(*) AS expected, count(d.sample_id) AS covered, count(*) - count(d.sample_id) AS missing FROM e LEFT JOIN d ON e.route = d.route AND e.sample_id = d.sample_id GROUP BY 1""")
def grid_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("sample_id is not null")
    return audits.coverage(m, table(spark, d, "generated_images"), ["route", "sample_id"], "route")


@R.query("""WITH g AS (SELECT scene_id, sum(bokeh_jpeg_bytes) AS b FROM generated_images WHERE scene_id IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT scene_id FROM depth_encodings)
SELECT CAST(coalesce(sum(b) FILTER (p.scene_id IS NOT NULL), 0) AS BIGINT) AS present_size, CAST(coalesce(sum(b) FILTER (p.scene_id IS NULL), 0) AS BIGINT) AS missing_size, coalesce(sum(b) FILTER (p.scene_id IS NULL), 0) <= 500000000 AS allowed FROM g LEFT JOIN p ON g.scene_id = p.scene_id""")
def staging_budget(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generated_images").where("scene_id is not null").groupBy("scene_id").agg(F.sum("bokeh_jpeg_bytes").alias("b"))
    return audits.staging_budget(g, table(spark, d, "depth_encodings"), "scene_id", "b", 500_000_000)


def _sql_checks() -> str:
    from quern.plans.select_queries import _VIOLATED

    one = lambda n, body, key, sev="problem": f"SELECT '{n}' AS check_id, '{sev}' AS severity, count(*) AS n_bad, min(CAST({key} AS VARCHAR)) AS example FROM ({body})"
    flag = lambda n, cond, val, sev="problem": f"SELECT '{n}' AS check_id, '{sev}' AS severity, CAST(CASE WHEN {cond} THEN {val} ELSE 0 END AS BIGINT) AS n_bad, NULL AS example FROM (SELECT count(*) AS n, count(*) FILTER (is_k_censored) AS cens, count(DISTINCT control_version) AS v, count(DISTINCT depth_backend) AS b FROM manifest)"
    split = "(SELECT DISTINCT scene_id AS s, CASE WHEN (('0x' || substr(sha256('m:' || scene_id), 1, 8))::BIGINT % 10000) < 1000 THEN 'val' ELSE 'train' END AS want FROM manifest WHERE scene_id IS NOT NULL AND ('0x' || substr(sha256('h:' || scene_id), 1, 8))::BIGINT % 40 > 0)"
    files = "(SELECT DISTINCT 'depth/' || scene_id || '.png' AS depth_ref FROM depth_encodings WHERE scene_id IS NOT NULL)"
    refs = "(SELECT DISTINCT depth_ref FROM manifest WHERE depth_ref IS NOT NULL)"
    parts = [
        flag("empty_manifest", "n = 0", "1"),
        one("contract", f"SELECT sample_id FROM manifest WHERE len({_VIOLATED}) > 0", "sample_id"),
        one("duplicate_sample_id", "SELECT sample_id FROM manifest WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "sample_id"),
        one("unknown_route", "SELECT sample_id FROM manifest WHERE NOT coalesce(route IN ('a', 'b', 'c'), false)", "sample_id"),
        one("scene_on_both_sides", "SELECT scene_id FROM manifest WHERE scene_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1", "scene_id"),
        one("scene_not_in_split", f"SELECT scene_id FROM manifest LEFT JOIN {split} ON scene_id = s WHERE scene_id IS NOT NULL AND s IS NULL", "scene_id"),
        one("side_disagrees", f"SELECT scene_id FROM manifest JOIN {split} ON scene_id = s WHERE want <> split", "scene_id"),
        one("depth_unreachable", f"FROM {refs} EXCEPT FROM {files}", "depth_ref"),
        one("depth_orphan", f"FROM {files} EXCEPT FROM {refs}", "depth_ref", "warning"),
        one("not_in_ledger", "SELECT sample_id FROM manifest WHERE sample_id IS NOT NULL AND sample_id NOT IN (SELECT sample_id FROM generated_images WHERE sample_id IS NOT NULL)", "sample_id"),
        one("ledger_without_sample", "SELECT DISTINCT sample_id FROM generated_images WHERE sample_id IS NOT NULL AND sample_id NOT IN (SELECT sample_id FROM manifest WHERE sample_id IS NOT NULL)", "sample_id", "warning"),
        one("generated_without_digest", "SELECT sample_id FROM generated_images WHERE bokeh_path IS NOT NULL AND bokeh_jpeg_sha256 IS NULL", "sample_id"),
        one("scene_without_image", "SELECT DISTINCT scene_id FROM manifest WHERE scene_id IS NOT NULL AND scene_id NOT IN (SELECT scene_id FROM aif_images WHERE scene_id IS NOT NULL)", "scene_id"),
        flag("several_versions", "v > 1", "v"),
        flag("several_backends", "b > 1", "b"),
        flag("censored_share", "cens > 0.2 * n", "cens"),
        flag("some_censored", "cens > 0 AND cens <= 0.2 * n", "cens", "warning"),
        one("refined_flag_disagrees", "SELECT sample_id FROM manifest WHERE focus_source = 'sampled' AND focus_was_refined", "sample_id", "warning"),
    ]
    return "\nUNION ALL ".join(parts)


@R.query(_sql_checks())
def release_checks(spark: SparkSession, d: str) -> DataFrame:
    from quern.plans.select_queries import _VOCABULARY

    m = table(spark, d, "manifest")
    scenes = m.where("scene_id is not null").select("scene_id").distinct()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("h:"), "scene_id"), 256), 1, 8), 16, 10).cast("bigint")
    split = scenes.where(h % 40 > 0).withColumn("split", F.when(bucket("m", c("scene_id")) < 1000, "val").otherwise("train"))
    rules = release.manifest_rules(["ctl-1.4"], _VOCABULARY)
    return release.release_checks(m, table(spark, d, "aif_images"), table(spark, d, "depth_encodings"), table(spark, d, "generated_images"), split, rules)


@R.query("""SELECT K AS source_key, count(*) AS n FROM (SELECT regexp_replace(lower(source_dataset), '[^a-z0-9]', '', 'g') AS K FROM manifest INTERSECT SELECT regexp_replace(lower(source_dataset), '[^a-z0-9]', '', 'g') FROM aif_images) GROUP BY 1""")
def intersect_sources(spark: SparkSession, d: str) -> DataFrame:
    k = K("source_dataset").alias("source_key")
    return table(spark, d, "manifest").select(k).intersect(table(spark, d, "aif_images").select(k)).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH r AS (SELECT n_name FROM nation), a AS (SELECT n_name AS c FROM r) SELECT 1 AS size, c AS config FROM a UNION ALL SELECT 2, x.c || '+' || y.c FROM a x JOIN a y ON x.c < y.c UNION ALL SELECT 3, x.c || '+' || y.c || '+' || z.c FROM a x JOIN a y ON x.c < y.c JOIN a z ON y.c < z.c""")
def combinatorial_configs(spark: SparkSession, d: str) -> DataFrame:
    return audits.singles_pairs_triples(table(spark, d, "nation"), "n_name")
