"""Queries of sample records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import scene_of_image
from quern.operators import records
from quern.plans.registry import Registry, table

R = Registry()
c = F.col


@R.query("""SELECT row_id, sample_id, scene_id, route, is_valid_for_control AND NOT is_k_censored AS is_valid_for_control, focus_region_area_ratio AS mask_area_ratio, round(k_value / 65535.0 / 2, 12) AS quantisation_error_px FROM manifest""")
def flat_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    x = records.flat_metadata(records.nested_sample(m.withColumn("sample_id", F.struct("row_id", "sample_id"))))
    return x.select("sample_id.row_id", "sample_id.sample_id", "scene_id", "route", "is_valid_for_control", "mask_area_ratio", F.round("quantisation_error_px", 12).alias("quantisation_error_px"))


@R.query("""WITH s AS (SELECT scene_id, min(split) AS split FROM manifest WHERE scene_id IS NOT NULL GROUP BY 1) SELECT row_id, m.scene_id, s.split, route FROM manifest m LEFT JOIN s ON m.scene_id = s.scene_id""")
def manifest_projection(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    s = m.where("scene_id is not null").groupBy("scene_id").agg(F.min("split").alias("split"))
    return records.manifest_rows(m, s, ["row_id", "scene_id", "split", "route"])


@R.query("""WITH x AS (SELECT row_id, CASE WHEN level_no >= 1 THEN [1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0][level_no]::DOUBLE END AS v, CASE WHEN row_id % 9 = 0 THEN 2.8 END::DOUBLE AS named FROM route_c)
SELECT row_id, CASE WHEN v IS NULL THEN 'level_out_of_range' WHEN named IS NOT NULL AND abs(v - named) > 1e-6 * named THEN 'f_number_disagrees' END AS error, CASE WHEN error IS NULL THEN v END AS f_number FROM x""")
def f_number_for_level(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(*[F.lit(x) for x in (1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0)])
    v, e = records.f_number_for_level(values, c("level_no"), F.when(c("row_id") % 9 == 0, F.lit(2.8)))
    return table(spark, d, "route_c").select("row_id", e.alias("error"), v.alias("f_number"))


@R.query(r"""WITH k AS (SELECT regexp_replace(regexp_replace(source_sample_id, '_level_[0-9]+.*$', '', 's'), '_(aligned|misaligned|shift_[0-9.]+px)$', '') AS scene_key FROM route_c) SELECT scene_key, count(*) AS n FROM k GROUP BY 1""")
def first_grouping_key(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "route_c").select("row_id", "source_sample_id")
    name, keyed = records.choose_grouping(x, {"row": c("row_id"), "name": scene_of_image(c("source_sample_id"))})
    assert name == "name"
    return keyed.groupBy("scene_key").agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT scene_id AS folder, sha256(string_agg(encoding_id || ':' || coalesce(sha256, ''), chr(10) ORDER BY encoding_id || ':' || coalesce(sha256, ''))) AS digest, count(*) AS files FROM depth_encodings WHERE scene_id IS NOT NULL GROUP BY 1""")
def folder_digests(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "depth_encodings").where("scene_id is not null").select(c("scene_id").alias("folder"), c("encoding_id").cast("string").alias("p"), F.coalesce("sha256", F.lit("")).alias("h"))
    return records.folder_digest(x, "folder", "p", "h")


@R.query("""WITH x AS (SELECT unnest(thumb)::DOUBLE AS v FROM aif_images WHERE thumb IS NOT NULL) SELECT 'grey' AS channel, count(*) AS n, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99 FROM x
UNION ALL SELECT 'squared', count(*), round(quantile_cont(v * v, 0.01), 6), round(quantile_cont(v * v, 0.5), 6), round(quantile_cont(v * v, 0.99), 6) FROM x""")
def channel_calibration(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "aif_images").select("thumb")
    x = records.channel_calibration(t, {"grey": c("thumb"), "squared": F.transform("thumb", lambda v: v * v)}, {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    return x.select("channel", "n", *[F.round(q, 6).alias(q) for q in ("p01", "p50", "p99")])


@R.query("""SELECT vec_id, round(least(greatest(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.25), -0.05), 0.05), 9) AS draw FROM embeddings""")
def pool_draws(spark: SparkSession, d: str) -> DataFrame:
    e = c("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(records.pool_draw(e, F.lit(0.25), F.lit(-0.05), F.lit(0.05)), 9).alias("draw"))
