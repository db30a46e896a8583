"""Raster kernels in numpy over stacks of images (n, h, w): every function works on a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np

EPS = 1e-12


def shifted(x: np.ndarray, dy: int, dx: int, mode: str = "edge") -> np.ndarray:
    """x moved so that cell (i, j) holds the neighbour at (i + dy, j + dx); outside, the edge value or zero."""
    h, w = x.shape[-2:]
    pad = [(0, 0)] * (x.ndim - 2) + [(max(0, -dy), max(0, dy)), (max(0, -dx), max(0, dx))]
    p = np.pad(x, pad, mode="edge") if mode == "edge" else np.pad(x, pad)
    return p[..., max(0, dy) : max(0, dy) + h, max(0, dx) : max(0, dx) + w]


def laplacian(x: np.ndarray, border: str = "edge") -> np.ndarray:
    """Five-point Laplacian; border edge (replicated), zero (padded), or valid (interior only)."""
    if border == "valid":
        return x[..., :-2, 1:-1] + x[..., 2:, 1:-1] + x[..., 1:-1, :-2] + x[..., 1:-1, 2:] - 4 * x[..., 1:-1, 1:-1]
    return sum(shifted(x, a, b, border) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * x


def laplacian_variance(x: np.ndarray, border: str = "edge") -> np.ndarray:
    return laplacian(x, border).var(axis=(-2, -1))


def box_mean(x: np.ndarray, window: int) -> np.ndarray:
    """Mean over a square window that shrinks at the borders, by an integral image."""
    h, w = x.shape[-2:]
    r = window // 2
    total = np.zeros((*x.shape[:-2], h + 1, w + 1))
    total[..., 1:, 1:] = x.cumsum(-2).cumsum(-1)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    corner = lambda a, b: total[..., a[:, None], b[None, :]]
    return (corner(y1, x1) - corner(y0, x1) - corner(y1, x0) + corner(y0, x0)) / np.outer(y1 - y0, x1 - x0)


def gaussian_blur(x: np.ndarray, sigma: float | np.ndarray = 1.5, radius: int = 5) -> np.ndarray:
    """Separable Gaussian of the given radius, replicated edges; sigma is one for all images or one for each."""
    t = np.arange(-radius, radius + 1).reshape(-1, *[1] * np.ndim(sigma))
    k = np.exp(-(t**2) / (2 * np.asarray(sigma) ** 2))
    k = (k / k.sum(0)).reshape(*k.shape, *[1] * (2 * np.ndim(sigma)))
    t = t.ravel()
    rows = sum(c * shifted(x, 0, int(i)) for c, i in zip(k, t))
    return sum(c * shifted(rows, int(i), 0) for c, i in zip(k, t))


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of images in [0, 255], 11-cell Gaussian window of sigma 1.5."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = gaussian_blur(a), gaussian_blur(b)
    va, vb, vab = gaussian_blur(a * a) - ma * ma, gaussian_blur(b * b) - mb * mb, gaussian_blur(a * b) - ma * mb
    s = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return s.mean(axis=(-2, -1))


def psnr(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> np.ndarray:
    """Peak signal-to-noise ratio in dB; infinite for equal images."""
    mse = ((a - b) ** 2).mean(axis=(-2, -1))
    with np.errstate(divide="ignore"):
        return 10 * np.log10(peak * peak / mse)


def detail_maps(sharp: np.ndarray, blurred: np.ndarray, window: int = 3, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(retention, detail): blurred over sharp local detail, clipped to [0, 1], NaN where the sharp image has hardly any."""
    d, e = box_mean(np.abs(laplacian(sharp)), window), box_mean(np.abs(laplacian(blurred)), window)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(d > least, np.clip(e / d, 0, 1), np.nan), d


def sharpest_region(retention: np.ndarray, detail: np.ndarray, top: float = 0.2, texture_percentile: float = 50.0, least_area: float = 0.01) -> np.ndarray | None:
    """Mask of one image: of the cells above a texture percentile, the ``top`` share by retention, ties by detail, then place."""
    ok = np.isfinite(retention)
    if not ok.any():
        return None
    can = ok & (detail >= np.percentile(detail[ok], texture_percentile))
    floor = max(int(least_area * retention.size), 1)
    if can.sum() < floor:
        return None
    k = min(max(round(top * retention.size), floor), int(can.sum()))
    at = np.flatnonzero(can)
    best = at[np.lexsort((-detail.ravel()[at], -retention.ravel()[at]))[:k]]
    out = np.zeros(retention.size, bool)
    out[best] = True
    return out.reshape(retention.shape)


def refine_mask(first: np.ndarray | None, retention: np.ndarray, detail: np.ndarray, agree: float = 0.3, least_area: float = 0.01, **region: float) -> tuple[np.ndarray, str] | None:
    """(mask, source): the first mask where it reaches ``agree`` of the sharpest region, else their intersection where that is
    large enough, else the region; None if there is no region."""
    best = sharpest_region(retention, detail, least_area=least_area, **region)
    if best is None:
        return None
    if first is not None and first.any():
        both = first & best
        if both.sum() / max(best.sum(), 1) >= agree:
            return first, "initial"
        if both.sum() >= max(int(least_area * best.size), 1):
            return both, "refined"
    return best, "retention_only"


def erode(mask: np.ndarray, times: int = 1, square: bool = False) -> np.ndarray:
    """Erosion by the four neighbours, or all eight; outside the image counts as inside."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (square or not (a and b))]
    for _ in range(times):
        mask = np.logical_and.reduce([mask, *[shifted(mask, a, b) for a, b in near]])
    return mask


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a square of the given radius."""
    rows = np.logical_or.reduce([shifted(mask, 0, i, "zero") for i in range(-radius, radius + 1)])
    return np.logical_or.reduce([shifted(rows, i, 0, "zero") for i in range(-radius, radius + 1)])


def inside_outside_sharpness(x: np.ndarray, mask: np.ndarray, times: int = 3, least: int = 64) -> np.ndarray:
    """Mean Laplacian energy inside over outside the mask, both eroded; NaN (inapplicable) where either keeps fewer than ``least``
    cells, infinite where there is none outside."""
    e = laplacian(x) ** 2
    area = lambda m: m.sum(axis=(-2, -1))
    energy = lambda m: (e * m).sum(axis=(-2, -1)) / np.maximum(area(m), 1)
    a, b = erode(mask, times), erode(~mask, times)
    out = energy(b)
    ratio = np.where(out > 0, energy(a) / np.where(out > 0, out, 1), np.inf)
    return np.where((area(a) < least) | (area(b) < least), np.nan, ratio)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx, response): whole-cell shift of b against a by phase correlation under a Hann window; response is peak over mean."""
    h, w = a.shape[-2:]
    win = np.outer(np.hanning(h) if h > 1 else np.ones(1), np.hanning(w) if w > 1 else np.ones(1))
    f = lambda x: np.fft.rfft2((x - x.mean(axis=(-2, -1), keepdims=True)) * win)
    cross = f(a) * np.conj(f(b))
    size = np.abs(cross)
    surface = np.fft.irfft2(np.where(size > 0, cross / np.where(size > 0, size, 1), 0), s=(h, w)).reshape(*a.shape[:-2], h * w)
    at = surface.argmax(-1)
    dy, dx = at // w, at % w
    mean = np.abs(surface).mean(-1)
    peak = np.take_along_axis(surface, at[..., None], -1)[..., 0]
    return np.where(dy > h // 2, dy - h, dy), np.where(dx > w // 2, dx - w, dx), np.where(mean > 0, peak / np.where(mean > 0, mean, 1), 0.0)


def resample(x: np.ndarray, h: int, w: int, how: str = "nearest") -> np.ndarray:
    """x at h by w cells: nearest, bilinear (cell centres), or area (exact overlap means)."""
    sh, sw = x.shape[-2:]
    if how == "area":
        def weights(n: int, m: int) -> np.ndarray:
            edge, cell = np.arange(m + 1) * n / m, np.arange(n)
            over = np.minimum(edge[1:, None], cell[None, :] + 1) - np.maximum(edge[:-1, None], cell[None, :])
            return np.maximum(over, 0) * m / n

        return weights(sh, h) @ x @ weights(sw, w).T
    y, z = (np.arange(h) + 0.5) * sh / h - 0.5, (np.arange(w) + 0.5) * sw / w - 0.5
    if how == "nearest":
        return x[..., np.clip(np.floor(y + 0.5), 0, sh - 1).astype(int)[:, None], np.clip(np.floor(z + 0.5), 0, sw - 1).astype(int)[None, :]]
    y, z = np.clip(y, 0, sh - 1), np.clip(z, 0, sw - 1)
    y0, z0 = np.minimum(y.astype(int), max(sh - 2, 0)), np.minimum(z.astype(int), max(sw - 2, 0))
    y1, z1 = np.minimum(y0 + 1, sh - 1), np.minimum(z0 + 1, sw - 1)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    g = lambda a, b: x[..., a[:, None], b[None, :]]
    return (g(y0, z0) * (1 - fz) + g(y0, z1) * fz) * (1 - fy) + (g(y1, z0) * (1 - fz) + g(y1, z1) * fz) * fy


def gradients(z: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(d/dx, d/dy): central differences inside, one-sided at the edges."""
    gy, gx = np.gradient(z, step, axis=(-2, -1))
    return gx, gy


def second_derivatives(z: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(xx, yy, xy) by three-point and four-corner stencils, replicated edges."""
    xx = (shifted(z, 0, 1) - 2 * z + shifted(z, 0, -1)) / step**2
    yy = (shifted(z, 1, 0) - 2 * z + shifted(z, -1, 0)) / step**2
    xy = (shifted(z, 1, 1) - shifted(z, 1, -1) - shifted(z, -1, 1) + shifted(z, -1, -1)) / (4 * step**2)
    return xx, yy, xy


def area_element(z: np.ndarray, step: float = 1.0) -> np.ndarray:
    gx, gy = gradients(z, step)
    return np.sqrt(1 + gx**2 + gy**2)


def normals(z: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit normals of the surface (x, y, z(x, y))."""
    gx, gy = gradients(z, step)
    n = np.sqrt(1 + gx**2 + gy**2)
    return -gx / n, -gy / n, 1 / n


def monge_signals(z: np.ndarray, step: float = 1.0, clamp: float = 50.0) -> dict[str, np.ndarray]:
    """Gaussian (K) and mean (H) curvature, principal curvatures k1 <= k2, shape index, curvedness of the graph of z."""
    p, q = gradients(z, step)
    xx, yy, xy = second_derivatives(z, step)
    g = 1 + p * p + q * q
    K = (xx * yy - xy * xy) / (g * g)
    H = ((1 + q * q) * xx - 2 * p * q * xy + (1 + p * p) * yy) / (2 * g**1.5)
    r = np.sqrt(np.maximum(H * H - K, 0))
    k1, k2 = np.clip(H - r, -clamp, clamp), np.clip(H + r, -clamp, clamp)
    gap = k2 - k1
    shape = np.where(gap < 1e-8, 0.0, 2 / np.pi * np.arctan((k2 + k1) / (gap + 1e-8)))
    return {"K": np.clip(K, -clamp, clamp), "H": np.clip(H, -clamp, clamp), "k1": k1, "k2": k2, "shape_index": shape, "curvedness": np.sqrt((k1**2 + k2**2) / 2)}


def projected_curvature(z: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    """Gaussian curvature, in 1/m^2, of the surface that a depth map projects back to: (u - cx) z / fx, (v - cy) z / fy, z."""
    h, w = z.shape[-2:]
    a, b = (np.arange(w) - cx)[None, :] / fx, (np.arange(h) - cy)[:, None] / fy
    zu, zv = gradients(z)
    zuu, zvv, zuv = second_derivatives(z)
    at = lambda du, dv, ea, eb: np.stack([a * dv + ea, b * dv + eb, dv + 0 * a + 0 * b], -1)
    su, sv = at(0, zu, z / fx, 0 * z), at(0, zv, 0 * z, z / fy)
    suu, svv, suv = at(0, zuu, 2 * zu / fx, 0 * z), at(0, zvv, 0 * z, 2 * zv / fy), at(0, zuv, zv / fx, zu / fy)
    n = np.cross(su, sv)
    n = n / (np.linalg.norm(n, axis=-1, keepdims=True) + EPS)
    dot = lambda x, y: (x * y).sum(-1)
    E, F, G = dot(su, su), dot(su, sv), dot(sv, sv)
    den = E * G - F * F
    return (dot(suu, n) * dot(svv, n) - dot(suv, n) ** 2) / np.where(np.abs(den) < EPS, EPS, den)


def occlusion(z: np.ndarray, tau: float | None = None, percentile: float = 97.0) -> np.ndarray:
    """Gradient magnitude over tau, or over its own percentile, clipped to [0, 1]."""
    gx, gy = gradients(z)
    g = np.hypot(gx, gy)
    top = np.percentile(g, percentile, axis=(-2, -1), keepdims=True) if tau is None else tau
    return np.clip(g / (top + 1e-8), 0, 1)


def geometry_stack(disparity: np.ndarray, u_max: float, s_max: float, tau: float) -> np.ndarray:
    """Six channels in [0, 1]: disparity, occlusion, area element, both tangential normals (0.5 is straight on), validity."""
    ok = np.isfinite(disparity) & (disparity > 0)
    d = np.where(ok, disparity, 0)
    nx, ny, _ = normals(d)
    o = np.where(erode(ok), occlusion(d, tau), 0)
    return np.stack([np.clip(d / u_max, 0, 1), o, np.clip(area_element(d) / s_max, 0, 1), (nx + 1) / 2, (ny + 1) / 2, ok.astype(float)], axis=-3)


def border_error(pred: np.ndarray, target: np.ndarray, border: np.ndarray, theta: float, valid: np.ndarray | None = None, times: int = 1) -> dict[str, float]:
    """Mean absolute error inside and outside border > theta, within the eroded valid cells, their ratio and the border's share;
    NaN where a region is empty."""
    v = erode(np.ones(pred.shape, bool) if valid is None else valid, times)
    e, b = np.abs(pred - target), (border > theta) & v
    out = (border <= theta) & v
    inside, outside = (float(e[m].mean()) if m.any() else float("nan") for m in (b, out))
    return {"e_bleed": inside, "e_out": outside, "ratio": inside / outside if outside > 0 else float("nan"), "border_share": float(b.sum() / v.sum()) if v.any() else float("nan")}


def depth_edges(z: np.ndarray, threshold: float = 0.08, percentile: float | None = 99.0) -> np.ndarray:
    """Cells whose gradient exceeds threshold times its percentile (None: its maximum, as in the superseded variant)."""
    gx, gy = (shifted(z, 0, 1) - shifted(z, 0, -1)) / 2, (shifted(z, 1, 0) - shifted(z, -1, 0)) / 2
    g = np.sqrt(gx**2 + gy**2 + EPS)
    top = g.max(axis=(-2, -1), keepdims=True) if percentile is None else np.percentile(g, percentile, axis=(-2, -1), keepdims=True)
    return g > threshold * np.maximum(top, 1e-6)


def boundary_scores(pred: np.ndarray, target: np.ndarray, tolerance: int = 2, threshold: float = 0.08, percentile: float | None = 99.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(precision, recall, F) of predicted edges within ``tolerance`` cells of target edges."""
    p, t = depth_edges(pred, threshold, percentile), depth_edges(target, threshold, percentile)
    hit = lambda a, b: (a & dilate(b, tolerance)).sum(axis=(-2, -1)) / np.maximum(a.sum(axis=(-2, -1)), 1)
    pr, rc = hit(p, t), hit(t, p)
    return pr, rc, np.where(pr + rc > 0, 2 * pr * rc / np.where(pr + rc > 0, pr + rc, 1), 0.0)


SWEEP = (0.02, 0.04, 0.06, 0.08, 0.12, 0.16, 0.24, 0.32)


def boundary_sweep(pred: np.ndarray, target: np.ndarray, tolerance: int = 2, thresholds: tuple[float, ...] = SWEEP) -> dict[str, np.ndarray]:
    """Best F over the edge thresholds, the first threshold that reaches it, precision and recall there, and the mean F."""
    all_of = [boundary_scores(pred, target, tolerance, t) for t in thresholds]
    p, r, f = (np.stack([x[i] for x in all_of]) for i in range(3))
    k = f.argmax(0)
    at = lambda x: np.take_along_axis(x, k[None], 0)[0]
    return {"fmax": at(f), "fmax_threshold": np.array(thresholds)[k], "precision": at(p), "recall": at(r), "f_mean": f.mean(0)}


def local_laplacian_variance(x: np.ndarray, window: int = 3) -> np.ndarray:
    """Variance of the Laplacian in a window about each cell."""
    e = laplacian(x)
    return np.maximum(box_mean(e * e, window) - box_mean(e, window) ** 2, 0)


def edge_band(z: np.ndarray, threshold: float = 0.08, radius: int = 1) -> np.ndarray:
    return dilate(depth_edges(z, threshold), radius)


def token_weights(border: np.ndarray, lam: float, theta: float, token: int = 16, pool: str = "max") -> np.ndarray:
    """Weight of each token block: 1 + lam where its pooled border exceeds theta (theta 0: 1 + lam times it). Divide by the mean
    over the table, an aggregate: an Arrow batch is no unit of it."""
    n, h, w = border.shape
    blocks = border.reshape(n, h // token, token, w // token, token)
    o = blocks.max((2, 4)) if pool == "max" else blocks.mean((2, 4))
    return 1 + lam * (o if theta == 0 else (o > theta))


def losses(pred: np.ndarray, target: np.ndarray, step: float = 1.0) -> dict[str, np.ndarray]:
    """Values of the loss terms of each pair: berhu, gradient, normal, curvature, arc (geodesic), metric, scale."""
    mean = lambda x: x.mean(axis=(-2, -1))
    d = np.abs(pred - target)
    c = 0.2 * np.maximum(d.max(axis=(-2, -1), keepdims=True), 1e-6)
    (px, py), (tx, ty) = gradients(pred, step), gradients(target, step)
    cos = sum(a * b for a, b in zip(normals(pred, step), normals(target, step)))
    tensor = np.sqrt((px**2 - tx**2) ** 2 + 2 * (px * py - tx * ty) ** 2 + (py**2 - ty**2) ** 2)
    return {
        "berhu": mean(np.where(d <= c, d, (d * d + c * c) / (2 * c))),
        "gradient": mean(np.abs(px - tx) + np.abs(py - ty)),
        "normal": mean(1 - np.clip(cos, -1, 1)),
        "curvature": mean(np.abs(monge_signals(pred, step)["K"] - monge_signals(target, step)["K"])),
        "arc": mean(np.abs(area_element(pred, step) - area_element(target, step))),
        "metric": mean(np.minimum(tensor, 100.0)),
        "scale": np.abs(np.log(np.maximum(mean(pred), 1e-6)) - np.log(np.maximum(mean(target), 1e-6))),
    }


def radial_profile(x: np.ndarray, cy: int, cx: int) -> np.ndarray:
    """Mean value at each whole radius from the centre, up to the nearest edge; what lies beyond counts there."""
    h, w = x.shape[-2:]
    top = min(cy, cx, h - 1 - cy, w - 1 - cx)
    r = np.minimum(np.hypot(np.arange(h)[:, None] - cy, np.arange(w)[None, :] - cx).astype(int), top).ravel()
    rings = np.zeros((h * w, top + 1))
    rings[np.arange(h * w), r] = 1 / np.maximum(np.bincount(r, minlength=top + 1), 1)[r]
    return x.reshape(*x.shape[:-2], h * w) @ rings


def blur_radius(x: np.ndarray, cy: int, cx: int, share: float = 0.95) -> np.ndarray:
    """Radius that holds ``share`` of the ring-weighted energy, scaled to the radius of a uniform disc; 0 without energy."""
    p = radial_profile(x, cy, cx)
    e = p * 2 * np.pi * np.maximum(np.arange(p.shape[-1]), 0.5)
    total = e.sum(-1, keepdims=True)
    over = e.cumsum(-1) >= share * np.where(total > 0, total, np.inf)
    at = np.where(over.any(-1), over.argmax(-1), p.shape[-1] - 1)
    return np.where(total[..., 0] > 0, at / np.sqrt(share), 0.0)


def bracketed_search(objective, low: np.ndarray, high: np.ndarray, coarse: int = 9, steps: int = 20, growth: float = 2.0, most: float = 1e3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, value, censored) for each of n searches at once; objective maps n places to n values, to be made largest.

    A coarse grid; where the best lies on the upper bound, the bound grows, up to ``most``; then golden sections about the
    best. Censored: the best grid point still lies on the upper bound.
    """
    low, high = low.astype(float), high.astype(float)
    while True:
        grid = np.linspace(low, high, coarse)
        value = np.stack([objective(x) for x in grid])
        k = value.argmax(0)
        grow = (k == coarse - 1) & (high * growth <= most)
        if not grow.any():
            break
        low, high = np.where(grow, grid[-2], low), np.where(grow, high * growth, high)
    at = lambda x, i: np.take_along_axis(x, np.clip(i, 0, coarse - 1)[None], 0)[0]
    a, b, ratio = at(grid, k - 1), at(grid, k + 1), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        left = objective(c) >= objective(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    x = (a + b) / 2
    f, top = objective(x), at(value, k)
    return np.where(f >= top, x, at(grid, k)), np.maximum(f, top), k == coarse - 1
