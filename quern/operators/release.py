"""A release as one table of checks: every check is a row with its severity, the number of bad cases and an example."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.contract import finite, violations


def manifest_rules(versions: list[str], vocabularies: dict[str, list[str]]) -> dict[str, Column]:
    """Contract of a manifest row: rule name -> condition that breaks it."""
    c = F.col
    blank = lambda x: c(x).isNull() | (F.btrim(c(x)) == "")
    out = {f"missing_{x}": blank(x) for x in ("sample_id", "scene_id", "route", "source_dataset")}
    out |= {f"not_positive_{x}": ~(finite(c(x)) & (c(x) > 0)) for x in ("k_value", "focus_disparity")}
    out |= {f"unknown_{x}": c(x).isNotNull() & ~c(x).isin(words) for x, words in vocabularies.items()}
    out["version"] = ~F.coalesce(c("control_version").isin(versions), F.lit(False))
    out["resolution"] = ~F.coalesce((c("image_h") > 0) & (c("image_w") > 0), F.lit(False))
    out["depth_resolution"] = F.coalesce((c("depth_h") > c("image_h")) | (c("depth_w") > c("image_w")), F.lit(False))
    out["censored_but_valid"] = F.coalesce(c("is_k_censored") & c("is_valid_for_control"), F.lit(False))
    out["sampled_but_refined"] = F.coalesce((c("focus_source") == "sampled") & c("focus_was_refined"), F.lit(False))
    return out


def release_checks(manifest: DataFrame, images: DataFrame, depths: DataFrame, ledger: DataFrame, split: DataFrame, rules: dict[str, Column], censored_most: float = 0.2) -> DataFrame:
    """(check_id, severity, n_bad, example) of a release: manifest rows, source images, depth files, the ledger of generated
    pixels, and the split (scene_id, split).

    severity is problem, or warning for what doesn't stop a release. A check without a bad case has n_bad 0 and no example;
    the example is the smallest bad key. An empty manifest is itself a problem.
    """

    def rows(bad: DataFrame, key: Column, name: str, severity: str = "problem") -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("n_bad"), F.min(key.cast("string")).alias("example")).select(F.lit(name).alias("check_id"), F.lit(severity).alias("severity"), "n_bad", "example")

    c = F.col
    broken = manifest.withColumn("_v", violations(rules)).where(F.size("_v") > 0)
    side = split.select(c("scene_id").alias("_s"), c("split").alias("_want"))
    placed = manifest.join(side, c("scene_id") == c("_s"), "left")
    sides = manifest.where("scene_id is not null and split is not null").groupBy("scene_id").agg(F.countDistinct("split").alias("n"))
    refs = manifest.where("depth_ref is not null").select("depth_ref").distinct()
    files = depths.select(F.concat(F.lit("depth/"), c("scene_id"), F.lit(".png")).alias("depth_ref")).where("depth_ref is not null").distinct()
    by_sample = ledger.where("sample_id is not null").select("sample_id").distinct()
    total = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("is_k_censored")).alias("cens"))
    share = F.coalesce(F.try_divide("cens", "n"), F.lit(0.0))
    one = lambda df, cond, name, n, sev="problem": df.select(F.lit(name).alias("check_id"), F.lit(sev).alias("severity"), F.when(cond, n).otherwise(0).cast("bigint").alias("n_bad"), F.lit(None).cast("string").alias("example"))
    versions = manifest.agg(F.countDistinct("control_version").alias("v"), F.countDistinct("depth_backend").alias("b"))
    checks = [
        one(total, c("n") == 0, "empty_manifest", F.lit(1)),
        rows(broken, c("sample_id"), "contract"),
        rows(manifest.where("sample_id is not null").groupBy("sample_id").count().where("count > 1"), c("sample_id"), "duplicate_sample_id"),
        rows(manifest.where(~F.coalesce(c("route").isin("a", "b", "c"), F.lit(False))), c("sample_id"), "unknown_route"),
        rows(sides.where("n > 1"), c("scene_id"), "scene_on_both_sides"),
        rows(placed.where("scene_id is not null and _s is null"), c("scene_id"), "scene_not_in_split"),
        rows(placed.where("_want <> split"), c("scene_id"), "side_disagrees"),
        rows(refs.join(files, "depth_ref", "left_anti"), c("depth_ref"), "depth_unreachable"),
        rows(files.join(refs, "depth_ref", "left_anti"), c("depth_ref"), "depth_orphan", "warning"),
        rows(manifest.where("sample_id is not null").join(by_sample, "sample_id", "left_anti"), c("sample_id"), "not_in_ledger"),
        rows(by_sample.join(manifest.select("sample_id").distinct(), "sample_id", "left_anti"), c("sample_id"), "ledger_without_sample", "warning"),
        rows(ledger.where("bokeh_path is not null and bokeh_jpeg_sha256 is null"), c("sample_id"), "generated_without_digest"),
        rows(manifest.where("scene_id is not null").select("scene_id").distinct().join(images.select("scene_id").distinct(), "scene_id", "left_anti"), c("scene_id"), "scene_without_image"),
        one(versions, c("v") > 1, "several_versions", c("v")),
        one(versions, c("b") > 1, "several_backends", c("b")),
        one(total, share > censored_most, "censored_share", c("cens")),
        one(total, (share > 0) & (share <= censored_most), "some_censored", c("cens"), "warning"),
        rows(manifest.where("focus_source = 'sampled' and focus_was_refined"), c("sample_id"), "refined_flag_disagrees", "warning"),
    ]
    return reduce(DataFrame.unionByName, checks)
