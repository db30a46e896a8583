"""Sample records: nested metadata to flat rows, levels, grouping keys, folder digests, channel calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.arrays import sorted_quantile
from quern.operators.ranking import quantiles
from quern.plans.staging import stage


def nested_sample(df: DataFrame) -> DataFrame:
    """Manifest-like flat columns as a nested record: refs, provenance and control label, the shape that writers take."""
    return df.select(
        "sample_id",
        "scene_id",
        F.struct("depth_ref").alias("refs"),
        F.struct("source_dataset", "source_sample_id", "route", "image_h", "image_w").alias("provenance"),
        F.struct("k_value", "focus_disparity", "max_coc", "k_source", F.col("is_valid_for_control").alias("valid"), F.col("is_k_censored").alias("censored")).alias("control"),
        F.struct("mask_source", F.col("focus_region_area_ratio").alias("area")).alias("focus"),
    )


def flat_metadata(samples: DataFrame) -> DataFrame:
    """One flat row for each nested record, with what follows from it: is_valid_for_control (valid and not censored),
    mask_area_ratio, and quantisation_error_px, the blur error of half a step of a 16-bit disparity in [0, 1]."""
    ctl = lambda n: F.col(f"control.{n}")
    return samples.select(
        "sample_id",
        "scene_id",
        "refs.*",
        "provenance.*",
        ctl("k_value"),
        ctl("focus_disparity"),
        ctl("max_coc"),
        ctl("k_source"),
        (ctl("valid") & ~ctl("censored")).alias("is_valid_for_control"),
        ctl("censored").alias("is_k_censored"),
        F.col("focus.area").alias("mask_area_ratio"),
        (ctl("k_value") / 65535.0 / 2).alias("quantisation_error_px"),
    )


def manifest_rows(meta: DataFrame, split: DataFrame, columns: list[str]) -> DataFrame:
    """The manifest's columns of flat metadata, with the side of each scene; the manifest is what later scans read."""
    return meta.drop("split").join(split.select("scene_id", "split"), "scene_id", "left").select(*columns)


def f_number_for_level(values: Column, level: Column, named: Column, tolerance: float = 1e-6) -> tuple[Column, Column]:
    """(f-number, error): the 1-based element of values, never clamped, which must agree with the one in the name, if any."""
    v = F.when(level >= 1, F.try_element_at(values, level))
    error = F.when(v.isNull(), "level_out_of_range").when(named.isNotNull() & (F.abs(v - named) > tolerance * F.abs(named)), "f_number_disagrees")
    return F.when(error.isNull(), v), error


def choose_grouping(df: DataFrame, candidates: dict[str, Column]) -> tuple[str | None, DataFrame]:
    """(name, df with ``scene_key``) by the first candidate that really groups: between one and all but one distinct keys."""
    x = stage(df.select("*", *[k.cast("string").alias(f"__{n}") for n, k in candidates.items()]), "keys")
    total = x.count()
    for n in candidates:  # a few named strategies; each is one aggregate, and the first that fits ends the search
        d = x.where(F.col(f"__{n}").isNotNull()).agg(F.countDistinct(f"__{n}")).first()[0]
        if 0 < d < total:
            return n, x.select(*df.columns, F.col(f"__{n}").alias("scene_key"))
    return None, df.withColumn("scene_key", F.lit(None).cast("string"))


def folder_digest(files: DataFrame, folder: str, path: str, digest: str) -> DataFrame:
    """(folder, digest, files): SHA-256 over a folder's sorted "path:digest" lines; a folder's listing is its group."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", path, digest))), "\n")
    return files.groupBy(folder).agg(F.sha2(lines, 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def channel_calibration(df: DataFrame, channels: dict[str, Column], qs: dict[str, float]) -> DataFrame:
    """(channel, n, quantiles): exact quantiles of the pooled cells of array columns; no cell is sampled away."""
    pooled = None
    for n, a in channels.items():
        one = df.select(F.lit(n).alias("channel"), F.explode(a.cast("array<double>")).alias("v"))
        pooled = one if pooled is None else pooled.unionByName(one)
    return quantiles(pooled, ["channel"], "v", qs)


def pool_draw(pool: Column, u: Column, low: Column, high: Column) -> Column:
    """Quantile u of an array of values, brought into [low, high]."""
    return F.least(F.greatest(sorted_quantile(pool, u), low), high)
