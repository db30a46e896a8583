"""Measures on array columns: higher-order functions where they suffice, numpy over Arrow batches for stencils."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stack(s: pd.Series, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(images, ok): the rows of h*w numbers as (n, h, w) doubles, and which rows they are of s; others are left out."""
    ok = s.map(lambda a: a is not None and len(a) == h * w).to_numpy(bool)
    good = s[ok]
    return (np.stack(good.to_list()).astype(float) if len(good) else np.zeros((0, h * w))).reshape(-1, h, w), ok


def raster(kernel: Callable[..., dict[str, np.ndarray] | np.ndarray], h: int, w: int, kinds: str, inputs: int = 1):
    """A pandas UDF that applies a batch kernel to array columns of h*w cells, row-major.

    kernel gets (n, h, w) stacks and gives an array of n (maps are flattened to array<double>), or a dict of numbers for a
    struct of doubles of type ``kinds``. A row where an input is null or not of h*w cells gives null.
    """

    def run(*cols: pd.Series) -> pd.Series | pd.DataFrame:
        ok = np.logical_and.reduce([stack(c, h, w)[1] for c in cols])
        got = kernel(*[stack(c[ok], h, w)[0] for c in cols]) if ok.any() else None
        struct = ":" in kinds
        names = [x.split(":")[0].strip() for x in kinds[7:-1].split(",")] if struct else ["x"]
        out = {}
        for n in names:
            v = None if got is None else got[n] if struct else got
            col = np.full(len(ok), None, object)
            if v is not None:
                v = np.asarray(v, float)
                for i, x in zip(np.flatnonzero(ok), v.reshape(len(v), -1) if v.ndim > 1 else v):
                    col[i] = x
            out[n] = col
        if not struct:
            return pd.Series(out["x"]) if "array" in kinds else pd.Series(out["x"]).astype(float)
        return pd.DataFrame({n: pd.Series(c).astype(float) for n, c in out.items()})

    if inputs == 1:

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        def one_struct(a: pd.Series) -> pd.DataFrame:
            return run(a)

        return F.pandas_udf(one_struct if ":" in kinds else one, kinds)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def two_struct(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return run(a, b)

    return F.pandas_udf(two_struct if ":" in kinds else two, kinds)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def luma(b: Column, g: Column, r: Column) -> Column:
    """Grey values of three channel arrays, in BGR order."""
    return F.transform(F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r")), lambda c: 0.114 * c["b"] + 0.587 * c["g"] + 0.299 * c["r"])


def distinct_levels(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def coc(z: Column, focus_disparity: Column, k: Column) -> Column:
    """Signed blur radius K (1/z - focus) of each depth."""
    return F.transform(z, lambda x: k * (1.0 / x - focus_disparity))


def defocus(z: Column, focus_disparity: Column, k: Column, most: float = 100.0) -> Column:
    """Blur radius over ``most``, in [0, 1]."""
    return F.transform(coc(z, focus_disparity, k), lambda c: F.when(c.isNotNull(), F.least(F.abs(c) / most, F.lit(1.0))))


def band(c: Column, width: float) -> Column:
    return F.transform(c, lambda x: F.abs(x) <= width)


def share(mask: Column) -> Column:
    """Share of true cells; null for an empty array."""
    return F.try_divide(F.size(F.filter(mask, lambda x: x)), F.size(mask))


def saturation(c: Column, most: float) -> Column:
    """Share of cells at or above ``most`` in absolute value."""
    return share(F.transform(c, lambda x: F.abs(x) >= most))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks; null (inapplicable) where both are empty."""
    count = lambda f: F.size(F.filter(F.zip_with(a, b, f), lambda x: x))
    return F.try_divide(count(lambda x, y: x & y), count(lambda x, y: x | y))


def border_cells(h: int, w: int) -> list[int]:
    """Places of the first and last row and column; corners come twice, as both."""
    return [*range(w), *range((h - 1) * w, h * w), *range(0, h * w, w), *range(w - 1, h * w, w)]


def border_coverage(mask: Column, h: int, w: int) -> Column:
    at = F.array(*[F.lit(i) for i in border_cells(h, w)])
    return share(F.transform(at, lambda i: mask[i]))


def sorted_quantile(a: Column, q: Column | float) -> Column:
    """Linearly interpolated quantile of an array's non-null numbers."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)))
    at = (F.size(s) - 1) * (F.lit(q) if isinstance(q, float) else q)
    low = F.floor(at).cast("int")
    return F.when(F.size(s) > 0, s[low] + (s[F.ceil(at).cast("int")] - s[low]) * (at - low))


def focus_disparity(z: Column, mask: Column, least_m: float = 0.05, most_m: float = 1000.0) -> tuple[Column, Column]:
    """(disparity, error): the median of 1/z over the masked, finite, positive depths, or a slug: focus_mask_empty,
    focus_depth_implausible."""
    ok = F.filter(F.zip_with(z, mask, lambda x, m: F.when(m & (x > 0) & (x < float("inf")), 1.0 / x)), lambda x: x.isNotNull())
    d = sorted_quantile(ok, 0.5)
    depth = F.try_divide(F.lit(1.0), d)
    slug = F.when(d.isNull(), "focus_mask_empty").when(~depth.between(least_m, most_m), "focus_depth_implausible")
    return F.when(slug.isNull(), d), slug


def depth_problem(z: Column, least_finite: float = 0.999, least_ratio: float = 1.02) -> Column:
    """Why a depth array isn't usable, or null: depth_non_finite, depth_non_positive, depth_range_degenerate."""
    fine = F.filter(z, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    pos = F.filter(fine, lambda x: x > 0)
    n = F.size(z)
    return F.when(F.size(fine) < least_finite * n, "depth_non_finite").when(F.size(pos) < least_finite * n, "depth_non_positive").when(F.array_max(pos) < least_ratio * F.array_min(pos), "depth_range_degenerate")


def quantise_u16(a: Column, low: Column, high: Column) -> Column:
    """Cells as 0..65535 between low and high, rounded half to even; null cells stay null, a range of zero gives zeros."""
    return F.transform(a, lambda x: F.when(x.isNotNull(), F.bround(F.least(F.greatest(F.try_divide(x - low, high - low), F.lit(0.0)), F.lit(1.0)) * 65535, 0).cast("int")))


def dequantise_u16(a: Column, low: Column, high: Column) -> Column:
    return F.transform(a, lambda x: low + x / 65535.0 * (high - low))


def quantisation_bound(low: Column, high: Column) -> Column:
    """Largest error of a dequantised cell: half a step."""
    return (high - low) / 65535.0 / 2
