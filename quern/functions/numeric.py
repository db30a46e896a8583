"""Scalar formulas: optics, unit conversions, resize plans, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.contract import finite

#: The width of a full-frame sensor in mm, and mm in a metre.
FULL_FRAME_MM, MM_PER_M = 36.0, 1000.0


def k_from_optics(focal_mm: Column, f_number: Column, focal_35mm: Column, focus_m: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """(K, error): blur strength from optics, K = f^2 z / (2 F (z - f)) * px/mm / 1000, with z and f in mm and px/mm the longest
    edge over the sensor width, 36 f / f35. The error is the slug of the first input or step that fails; then K is null."""
    good = lambda c: finite(c) & (c > 0)
    sensor = F.try_divide(F.lit(FULL_FRAME_MM) * focal_mm, focal_35mm)
    px_mm = F.try_divide(F.greatest(h, w).cast("double"), sensor)
    z = focus_m * MM_PER_M
    k = F.try_divide(focal_mm * focal_mm * z, 2.0 * f_number * (z - focal_mm)) * px_mm / MM_PER_M
    error = (
        F.when(~good(focal_mm), "exif_focal_length_missing")
        .when(~good(focal_35mm), "sensor_width_unresolvable")
        .when(~F.coalesce((h > 0) & (w > 0), F.lit(False)), "resolution_invalid")
        .when(~good(f_number), "exif_f_number_missing")
        .when(~F.coalesce(z > focal_mm, F.lit(False)), "focus_distance_below_focal_length")
        .when(~finite(k), "k_non_finite")
        .when(k <= 0, "k_non_positive")
    )
    return F.when(error.isNull(), k), error


def k_at_resolution(k: Column, h: Column, w: Column, short_side: int) -> Column:
    """K rescaled to the resolution whose short side is given."""
    return k * F.try_divide(F.lit(float(short_side)), F.least(h, w))


def k_for_normalised(k: Column, low: Column, high: Column) -> Column:
    """K for disparities normalised to [0, 1]; null where the range is empty."""
    return F.when(high > low, k * (high - low))


def signed_coc(z: Column, focus_disparity: Column, k: Column) -> Column:
    return k * (F.try_divide(F.lit(1.0), z) - focus_disparity)


def defocus(coc: Column, most: float = 100.0) -> Column:
    return F.when(coc.isNotNull(), F.least(F.abs(coc) / most, F.lit(1.0)))


def relative_error(value: Column, reference: Column) -> Column:
    return F.try_divide(F.abs(value - reference), F.abs(reference))


def within(value: Column, reference: Column, tolerance: float) -> Column:
    """Whether value is within a relative tolerance of reference; false where either is missing or reference is zero."""
    return F.coalesce(relative_error(value, reference) <= tolerance, F.lit(False))


def resize_plan(h: Column, w: Column, short_side: int, align: int = 16) -> dict[str, Column]:
    """Scaled height and width (short side as asked, rounded half to even), the aligned crop, and its centred offset."""
    s = F.lit(float(short_side)) / F.least(h, w)
    sh, sw = F.bround(h * s, 0).cast("int"), F.bround(w * s, 0).cast("int")
    ch, cw = sh - sh % align, sw - sw % align
    return {"scaled_h": sh, "scaled_w": sw, "crop_h": ch, "crop_w": cw, "top": F.floor((sh - ch) / 2).cast("int"), "left": F.floor((sw - cw) / 2).cast("int")}


def cosine_schedule(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    """Rate at a step: linear to 1 over the warm-up, then half a cosine down to ``least`` at total, and least beyond."""
    part = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * part)))
