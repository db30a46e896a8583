"""Queries of array and raster measures, on the grey previews and the embeddings as 8 by 8 rasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import arrays, kernels
from quern.plans.registry import Registry, table
from quern.plans.staging import spread

R = Registry()
c = F.col
_CELLS = "cells AS (SELECT image_id, i // 8 AS y, i % 8 AS x, CAST(thumb[i + 1] AS DOUBLE) AS v FROM aif_images, range(64) t(i) WHERE thumb IS NOT NULL AND len(thumb) = 64)"
_LAP = f"""WITH {_CELLS}, lap AS (SELECT c.image_id, c.y, c.x, coalesce(u.v, {{o}}) + coalesce(d.v, {{o}}) + coalesce(l.v, {{o}}) + coalesce(r.v, {{o}}) - 4 * c.v AS e FROM cells c LEFT JOIN cells u ON u.image_id = c.image_id AND u.y = c.y - 1 AND u.x = c.x
LEFT JOIN cells d ON d.image_id = c.image_id AND d.y = c.y + 1 AND d.x = c.x LEFT JOIN cells l ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x - 1 LEFT JOIN cells r ON r.image_id = c.image_id AND r.y = c.y AND r.x = c.x + 1)
"""

def _grid(name: str, values: str, scale: str) -> str:
    """SQL of name: each cell's value z, its gradients p and q, and second derivatives, edges replicated; values: array expression."""
    at = lambda dy, dx: f"v[greatest(0, least(7, i // 8 + ({dy}))) * 8 + greatest(0, least(7, i % 8 + ({dx}))) + 1] / {scale}"
    return f"""{name} AS (SELECT image_id, i, {at(0, 0)} AS z, ({at(0, 1)} - {at(0, -1)}) / CASE WHEN i % 8 IN (0, 7) THEN 1 ELSE 2 END AS p, ({at(1, 0)} - {at(-1, 0)}) / CASE WHEN i // 8 IN (0, 7) THEN 1 ELSE 2 END AS q,
  {at(0, 1)} - 2 * {at(0, 0)} + {at(0, -1)} AS xx, {at(1, 0)} - 2 * {at(0, 0)} + {at(-1, 0)} AS yy, ({at(1, 1)} - {at(1, -1)} - {at(-1, 1)} + {at(-1, -1)}) / 4 AS xy
  FROM (SELECT image_id, {values} AS v FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64), range(64) t(i))"""


_THUMB = "CAST(thumb AS DOUBLE[])"
_FLIP = "list_transform(range(64), lambda j: CAST(thumb[(j // 8) * 8 + 8 - j % 8] AS DOUBLE))"
_GAUSS = "greatest(-50, least(50, (xx * yy - xy * xy) / ((1 + p * p + q * q) * (1 + p * p + q * q))))"


def _thumbs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "aif_images").where("thumb is not null and size(thumb) = 64")
    return spread(x.select("image_id", c("thumb").cast("array<double>").alias("thumb")), "image_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each preview with its own horizontal mirror image: a second raster that depends on nothing else."""
    flip = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: c("thumb")[F.floor(i / 8).cast("int") * 8 + 7 - i % 8])
    return _thumbs(spark, d).withColumn("other", flip)


@R.query(_LAP.format(o="c.v") + "SELECT image_id, round(var_pop(e), 6) AS laplacian_var FROM lap GROUP BY 1")
def stencil_laplacian_2d(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(kernels.laplacian_variance, 8, 8, "double")
    return _thumbs(spark, d).select("image_id", F.round(f("thumb"), 6).alias("laplacian_var"))


@R.query(_LAP.format(o="0") + "SELECT image_id, round(var_pop(e), 6) AS zero_border, round(var_pop(e) FILTER (y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6), 6) AS interior FROM lap GROUP BY 1")
def laplacian_borders(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda x: {"zero_border": kernels.laplacian_variance(x, "zero"), "interior": kernels.laplacian_variance(x, "valid")}, 8, 8, "struct<zero_border:double,interior:double>")
    return _thumbs(spark, d).select("image_id", f("thumb").alias("s")).select("image_id", *[F.round(f"s.{n}", 6).alias(n) for n in ("zero_border", "interior")])


@R.query(f"WITH {_CELLS} SELECT a.image_id, CAST(a.y * 8 + a.x AS INTEGER) AS cell, round(avg(b.v), 6) AS box FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x")
def box_mean(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda x: kernels.box_mean(x, 3), 8, 8, "array<double>")
    return _thumbs(spark, d).select("image_id", F.posexplode(f("thumb")).alias("cell", "box")).withColumn("box", F.round("box", 6))


@R.query("SELECT vec_id, len(list_distinct(list_transform(embedding, lambda x: round(x, 2)))) AS levels, round(list_avg(embedding)::DOUBLE, 6) AS mean, round(len(list_filter(embedding, lambda x: abs(x) >= 0.2)) / len(embedding), 9) AS saturated FROM embeddings")
def array_reductions(spark: SparkSession, d: str) -> DataFrame:
    e = c("embedding").cast("array<double>")
    x = table(spark, d, "embeddings").select("vec_id", e.alias("e"), c("embedding"))
    return x.select("vec_id", F.size(F.array_distinct(F.transform("embedding", lambda v: F.round(v, 2)))).cast("bigint").alias("levels"), F.round(arrays.mean(c("e")), 6).alias("mean"), F.round(arrays.saturation(c("embedding"), 0.2), 9).alias("saturated"))


@R.query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(arrays.cosine(c("embedding"), c("other")), 6).alias("cosine"))


@R.query("""WITH x AS (SELECT image_id, list_transform(thumb, lambda v: CAST(round_even(v / 255.0 * 65535, 0) AS INTEGER)) AS q FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64)
SELECT image_id, list_sum(q)::BIGINT AS total, list_max(q) AS top, len(list_distinct(q)) AS levels FROM x""")
def quantize_u16(spark: SparkSession, d: str) -> DataFrame:
    q = _thumbs(spark, d).select("image_id", arrays.quantise_u16(c("thumb"), F.lit(0.0), F.lit(255.0)).alias("q"))
    return q.select("image_id", arrays.total(c("q")).cast("bigint").alias("total"), F.array_max("q").alias("top"), arrays.distinct_levels(c("q")).cast("bigint").alias("levels"))


@R.query("""WITH x AS (SELECT image_id, list_transform(thumb, lambda v: v > 128) AS a, list_transform(range(64), lambda i: thumb[(i // 8) * 8 + 8 - i % 8] > 128) AS b FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64),
n AS (SELECT image_id, a, len(list_filter(range(1, 65), lambda i: a[i] AND b[i])) AS shared, len(list_filter(range(1, 65), lambda i: a[i] OR b[i])) AS either FROM x)
SELECT image_id, round(shared / nullif(either, 0), 9) AS iou, round(len(list_filter(a, lambda v: v)) / 64, 9) AS area FROM n""")
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    on = lambda k: F.transform(k, lambda v: v > 128)
    x = _pairs(spark, d).select("image_id", on("thumb").alias("a"), on("other").alias("b"))
    return x.select("image_id", F.round(arrays.iou(c("a"), c("b")), 9).alias("iou"), F.round(arrays.share(c("a")), 9).alias("area"))


@R.query("""WITH t AS (SELECT image_id, list_transform(thumb, lambda v: v > 128) AS m FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64),
b AS (SELECT image_id, m, list_concat(list_concat(range(1, 9), range(57, 65)), list_concat(range(1, 65, 8), range(8, 65, 8))) AS places FROM t) SELECT image_id, round(len(list_filter(places, lambda i: m[i])) / 32, 9) AS border FROM b""")
def mask_border(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform("thumb", lambda v: v > 128)
    return _thumbs(spark, d).select("image_id", m.alias("m")).select("image_id", F.round(arrays.border_coverage(c("m"), 8, 8), 9).alias("border"))


@R.query("""WITH x AS (SELECT image_id, unnest(thumb) AS v, unnest(list_transform(range(64), lambda i: thumb[(i // 8) * 8 + 8 - i % 8])) AS o FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64)
SELECT image_id, round(avg(abs(v - o)) FILTER (v / 255.0 > 0.5), 6) AS e_bleed, round(avg(abs(v - o)) FILTER (v / 255.0 <= 0.5), 6) AS e_out FROM x GROUP BY 1""")
def ebleed(spark: SparkSession, d: str) -> DataFrame:
    def run(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        got = [kernels.border_error(x, y, x / 255.0, 0.5) for x, y in zip(a, b)]
        return {k: np.array([g[k] for g in got]) for k in ("e_bleed", "e_out")}

    f = arrays.raster(run, 8, 8, "struct<e_bleed:double,e_out:double>", 2)
    x = _pairs(spark, d).select("image_id", f("thumb", "other").alias("s"))
    return x.select("image_id", *[F.round(F.nanvl(c(f"s.{n}"), F.lit(None).cast("double")), 6).alias(n) for n in ("e_bleed", "e_out")])


@R.query("""WITH x AS (SELECT image_id, list_transform(list_filter(thumb, lambda v: v > 128), lambda v: 10.0 / v) AS r FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64)
SELECT image_id, CASE WHEN len(r) = 0 THEN 'focus_mask_empty' WHEN NOT (1 / list_aggregate(r, 'quantile_cont', 0.5)) BETWEEN 5 AND 20 THEN 'focus_depth_implausible' END AS slug, CASE WHEN slug IS NULL THEN round(list_aggregate(r, 'quantile_cont', 0.5), 9) END AS disparity FROM x""")
def focus_plane(spark: SparkSession, d: str) -> DataFrame:
    z = F.transform("thumb", lambda v: v / 10.0)
    disp, slug = arrays.focus_disparity(z, F.transform("thumb", lambda v: v > 128), 5.0, 20.0)
    return _thumbs(spark, d).select("image_id", slug.alias("slug"), F.round(disp, 9).alias("disparity"))


@R.query("""WITH x AS (SELECT image_id, list_transform(list_filter(thumb, lambda v: v > 0), lambda v: 12.0 * (100.0 / v - 0.8)) AS c FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64)
SELECT image_id, round(len(list_filter(c, lambda v: abs(v) <= 2.0)) / len(c), 9) AS in_band, round(list_aggregate(list_transform(c, lambda v: least(abs(v) / 100, 1.0)), 'quantile_cont', 0.99), 9) AS p99 FROM x WHERE len(c) > 0""")
def blur_maps(spark: SparkSession, d: str) -> DataFrame:
    z = F.transform(F.filter("thumb", lambda v: v > 0), lambda v: v / 100.0)
    x = _thumbs(spark, d).select("image_id", z.alias("z")).where("size(z) > 0")
    coc = arrays.coc(c("z"), F.lit(0.8), F.lit(12.0))
    return x.select("image_id", F.round(arrays.share(arrays.band(coc, 2.0)), 9).alias("in_band"), F.round(arrays.sorted_quantile(arrays.defocus(c("z"), F.lit(0.8), F.lit(12.0)), 0.99), 9).alias("p99"))


@R.query("""SELECT image_id, CASE WHEN len(list_filter(thumb, lambda v: v > 0)) < 0.999 * 64 THEN 'depth_non_positive' WHEN list_max(thumb) < 4.0 * list_min(list_filter(thumb, lambda v: v > 0)) THEN 'depth_range_degenerate' END AS problem FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64""")
def depth_validity(spark: SparkSession, d: str) -> DataFrame:
    return _thumbs(spark, d).select("image_id", arrays.depth_problem(c("thumb"), 0.999, 4.0).alias("problem"))


@R.query(f"""WITH {_CELLS}, b AS (SELECT image_id, y // 4 AS ty, x // 4 AS tx, max(v) / 255.0 AS o FROM cells GROUP BY ALL), w AS (SELECT image_id, ty, tx, CASE WHEN o > 0.8 THEN 4.0 ELSE 1.0 END AS w FROM b)
SELECT image_id, CAST(ty * 2 + tx AS INTEGER) AS token, round(w / (SELECT avg(w) FROM w), 9) AS weight FROM w""")
def token_weights(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda x: kernels.token_weights(x / 255.0, 3.0, 0.8, 4), 8, 8, "array<double>")
    w = _thumbs(spark, d).select("image_id", F.posexplode(f("thumb")).alias("token", "w"))
    return w.join(F.broadcast(w.agg(F.avg("w").alias("m")))).select("image_id", "token", F.round(c("w") / c("m"), 9).alias("weight"))


@R.query("""WITH x AS (SELECT image_id, unnest(thumb) AS a, unnest(list_transform(range(64), lambda i: thumb[(i // 8) * 8 + 8 - i % 8])) AS b FROM aif_images WHERE thumb IS NOT NULL AND len(thumb) = 64)
SELECT image_id, round(avg((a - b) ^ 2), 6) AS mse, CASE WHEN avg((a - b) ^ 2) > 0 THEN round(10 * log10(65025 / avg((a - b) ^ 2)), 6) END AS psnr FROM x GROUP BY 1""")
def image_pairs_psnr(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda a, b: {"mse": ((a - b) ** 2).mean((1, 2)), "psnr": kernels.psnr(a, b)}, 8, 8, "struct<mse:double,psnr:double>", 2)
    x = _pairs(spark, d).select("image_id", f("thumb", "other").alias("s"))
    return x.select("image_id", F.round("s.mse", 6).alias("mse"), F.when(c("s.psnr") < float("inf"), F.round("s.psnr", 6)).alias("psnr"))


@R.query()
def image_pairs_quality(spark: SparkSession, d: str) -> DataFrame:
    """SSIM and phase-correlation shift of each preview against its mirror image."""

    def run(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        dy, dx, resp = kernels.phase_shift(a, b)
        return {"ssim": kernels.ssim(a, b), "dy": dy, "dx": dx, "response": resp}

    f = arrays.raster(run, 8, 8, "struct<ssim:double,dy:double,dx:double,response:double>", 2)
    return _pairs(spark, d).select("image_id", f("thumb", "other").alias("s")).select("image_id", "s.*")


@R.query(f"""WITH {_grid("g", _THUMB, "16.0")}, o AS (SELECT image_id, quantile_cont(sqrt(p * p + q * q) * 16, 0.97) AS top FROM g GROUP BY 1),
h AS (SELECT *, (xx * yy - xy * xy) / ((1 + p * p + q * q) * (1 + p * p + q * q)) AS gk, ((1 + q * q) * xx - 2 * p * q * xy + (1 + p * p) * yy) / (2 * pow(1 + p * p + q * q, 1.5)) AS mh FROM g),
k AS (SELECT *, greatest(-50, least(50, mh - sqrt(greatest(mh * mh - gk, 0)))) AS k1, greatest(-50, least(50, mh + sqrt(greatest(mh * mh - gk, 0)))) AS k2 FROM h)
SELECT image_id, round(avg(greatest(-50, least(50, gk))), 6) AS "K", round(avg(greatest(-50, least(50, mh))), 6) AS "H", round(avg(k1), 6) AS k1, round(avg(k2), 6) AS k2,
  round(avg(CASE WHEN k2 - k1 < 1e-8 THEN 0 ELSE 2 / pi() * atan((k2 + k1) / (k2 - k1 + 1e-8)) END), 6) AS shape_index, round(avg(sqrt((k1 * k1 + k2 * k2) / 2)), 6) AS curvedness,
  round(avg(sqrt(1 + p * p + q * q)), 6) AS area, round(avg(greatest(0, least(1, sqrt(p * p + q * q) * 16 / (top + 1e-8)))), 6) AS occlusion FROM k JOIN o USING (image_id) GROUP BY 1""")
def surface_signals(spark: SparkSession, d: str) -> DataFrame:
    """Means over each preview, as a height field, of curvatures, shape index, curvedness, area element and occlusion."""

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        m = {**kernels.monge_signals(z / 16.0), "area": kernels.area_element(z / 16.0), "occlusion": kernels.occlusion(z)}
        return {k: v.mean((1, 2)) for k, v in m.items()}

    names = ("K", "H", "k1", "k2", "shape_index", "curvedness", "area", "occlusion")
    f = arrays.raster(run, 8, 8, "struct<" + ",".join(f"{n}:double" for n in names) + ">")
    return _thumbs(spark, d).select("image_id", f("thumb").alias("s")).select("image_id", *[F.round(f"s.{n}", 6).alias(n) for n in names])


@R.query(f"""WITH {_grid("g", "list_transform(CAST(thumb AS DOUBLE[]), lambda v: greatest(v, 0.0))", "255.0")},
e AS (SELECT g.*, (SELECT bool_and(n.z > 0) FROM g n WHERE n.image_id = g.image_id AND abs(n.i // 8 - g.i // 8) + abs(n.i % 8 - g.i % 8) <= 1) AS whole FROM g),
s AS (SELECT *, sqrt(1 + p * p + q * q) AS a FROM e), ch AS (SELECT image_id, i, unnest([0, 1, 2, 3, 4, 5]) AS c, unnest([least(1.0, z), CASE WHEN whole THEN least(1.0, sqrt(p * p + q * q) / (0.2 + 1e-8)) ELSE 0.0 END,
  least(1.0, a / 1.2), (1 - p / a) / 2, (1 - q / a) / 2, CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END]) AS v FROM s)
SELECT image_id, CAST(c AS INTEGER) AS channel, list(round(v, 6) ORDER BY i) AS cells FROM ch GROUP BY 1, 2""")
def geometry_stack(spark: SparkSession, d: str) -> DataFrame:
    """Six geometry channels of each preview as a disparity map, flattened, channel after channel."""
    f = arrays.raster(lambda z: kernels.geometry_stack(z / 255.0, 1.0, 1.2, 0.2).reshape(len(z), -1), 8, 8, "array<double>")
    whole = _thumbs(spark, d).select("image_id", F.transform(f("thumb"), lambda v: F.round(v, 6)).alias("v"))
    return whole.select("image_id", F.posexplode(F.array(*[F.slice("v", k * 64 + 1, 64) for k in range(6)])).alias("channel", "cells"))


@R.query(f"""WITH {_grid("g0", "list_transform(CAST(thumb AS DOUBLE[]), lambda v: 2 + v / 255.0)", "1.0")}, g AS (SELECT *, (i % 8 - 3.5) / 40.0 AS a, (i // 8 - 3.5) / 40.0 AS b FROM g0),
s AS (SELECT *, a * p + z / 40 AS ux, b * p AS uy, p AS uz, a * q AS vx, b * q + z / 40 AS vy, q AS vz FROM g),
c AS (SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz, (ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz) - pow(ux * vx + uy * vy + uz * vz, 2) AS den FROM s),
m AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) + {{eps}} AS len FROM c),
d AS (SELECT image_id, den, ((a * xx + 2 * p / 40) * cx + b * xx * cy + xx * cz) / len AS l, (a * yy * cx + (b * yy + 2 * q / 40) * cy + yy * cz) / len AS n, ((a * xy + q / 40) * cx + (b * xy + p / 40) * cy + xy * cz) / len AS m FROM m)
SELECT image_id, round(avg(abs((l * n - m * m) / CASE WHEN abs(den) < {{eps}} THEN {{eps}} ELSE den END)), 6) AS mean_abs_k FROM d GROUP BY 1""".replace("{eps}", repr(kernels.EPS)))
def projected_curvature(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda z: np.abs(kernels.projected_curvature(2 + z / 255.0, 40.0, 40.0, 3.5, 3.5)).mean((1, 2)), 8, 8, "double")
    return _thumbs(spark, d).select("image_id", F.round(f("thumb"), 6).alias("mean_abs_k"))


@R.query()
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.raster(lambda a, b: kernels.boundary_sweep(a, b, 1), 8, 8, "struct<fmax:double,fmax_threshold:double,precision:double,recall:double,f_mean:double>", 2)
    return _pairs(spark, d).select("image_id", f("thumb", "other").alias("s")).select("image_id", "s.*")


@R.query(f"""WITH {_grid("a", _THUMB, "255.0")}, {_grid("b", _FLIP, "255.0")}, ka AS (SELECT image_id, i, z, p, q, {_GAUSS} AS k, sqrt(1 + p * p + q * q) AS n FROM a), kb AS (SELECT image_id, i, z AS z2, p AS p2, q AS q2, {_GAUSS} AS k2, sqrt(1 + p * p + q * q) AS n2 FROM b),
j AS (SELECT *, abs(z - z2) AS d FROM ka JOIN kb USING (image_id, i)), w AS (SELECT *, 0.2 * greatest(max(d) OVER (PARTITION BY image_id), 1e-6) AS c FROM j)
SELECT image_id, round(avg(CASE WHEN d <= c THEN d ELSE (d * d + c * c) / (2 * c) END), 6) AS berhu, round(avg(abs(p - p2) + abs(q - q2)), 6) AS gradient, round(avg(1 - greatest(-1, least(1, (p * p2 + q * q2 + 1) / (n * n2)))), 6) AS normal,
  round(avg(abs(k - k2)), 6) AS curvature, round(avg(abs(n - n2)), 6) AS arc, round(avg(least(100, sqrt(pow(p * p - p2 * p2, 2) + 2 * pow(p * q - p2 * q2, 2) + pow(q * q - q2 * q2, 2)))), 6) AS metric,
  round(abs(ln(greatest(avg(z), 1e-6)) - ln(greatest(avg(z2), 1e-6))), 6) AS scale FROM w GROUP BY 1""")
def pair_losses(spark: SparkSession, d: str) -> DataFrame:
    names = ("berhu", "gradient", "normal", "curvature", "arc", "metric", "scale")
    f = arrays.raster(lambda a, b: kernels.losses(a / 255.0, b / 255.0), 8, 8, "struct<" + ",".join(f"{n}:double" for n in names) + ">", 2)
    return _pairs(spark, d).select("image_id", f("thumb", "other").alias("s")).select("image_id", *[F.round(f"s.{n}", 6).alias(n) for n in names])


@R.query()
def focus_regions(spark: SparkSession, d: str) -> DataFrame:
    """Source, share and retention of the refined focus region of each preview against a blurred copy of itself."""
    kinds = ["initial", "refined", "retention_only"]

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        ret, det = kernels.detail_maps(a, kernels.gaussian_blur(a, 1.0, 2))
        got = [kernels.refine_mask(x > 160, r, e, top=0.25) for x, r, e in zip(a, ret, det)]
        return {
            "source_no": np.array([np.nan if g is None else kinds.index(g[1]) for g in got], float),
            "area": np.array([np.nan if g is None else g[0].mean() for g in got]),
            "retention": np.array([np.nan if g is None or not np.isfinite(r[g[0]]).any() else np.nanmedian(r[g[0]]) for g, r in zip(got, ret)]),
            "edge_variance": np.array([v[b].mean() if b.any() else np.nan for v, b in zip(kernels.local_laplacian_variance(a), kernels.edge_band(a))]),
        }

    f = arrays.raster(run, 8, 8, "struct<source_no:double,area:double,retention:double,edge_variance:double>")
    return _thumbs(spark, d).select("image_id", f("thumb").alias("s")).select("image_id", "s.*")


@R.query()
def blur_radii(spark: SparkSession, d: str) -> DataFrame:
    """Blur radius by radial energy and the inside-to-outside sharpness of each preview, upsampled to 32 by 32."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        big = kernels.resample(a, 32, 32, "bilinear")
        return {"radius": kernels.blur_radius(big, 15, 15), "sharpness": kernels.inside_outside_sharpness(big, big > 128)}

    f = arrays.raster(run, 8, 8, "struct<radius:double,sharpness:double>")
    return _thumbs(spark, d).select("image_id", f("thumb").alias("s")).select("image_id", "s.*")


@R.query()
def best_blur_search(spark: SparkSession, d: str) -> DataFrame:
    """For each preview, the Gaussian width that makes it most alike its mirror image, by a bracketed search; censored at the bound."""

    def run(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        n = len(a)
        width, value, censored = kernels.bracketed_search(lambda s: kernels.ssim(kernels.gaussian_blur(a, s, 3), b), np.full(n, 0.3), np.full(n, 2.0), 6, 8, 2.0, 4.0)
        return {"width": width, "ssim": value, "censored": censored.astype(float)}

    f = arrays.raster(run, 8, 8, "struct<width:double,ssim:double,censored:double>", 2)
    return _pairs(spark, d).select("image_id", f("thumb", "other").alias("s")).select("image_id", "s.*")
