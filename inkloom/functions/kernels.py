"""Pixel kernels in numpy: filters, thresholds, morphology, components, geometry."""

from __future__ import annotations

import numpy as np


def odd(n: float) -> int:
    k = max(3, int(n))
    return k + 1 - k % 2


def _pad(a: np.ndarray, before: int, after: int, axis: int, mode: str, value=0) -> np.ndarray:
    width = [(0, 0)] * a.ndim
    width[axis] = (before, after)
    if mode == "constant":
        return np.pad(a, width, constant_values=value)
    return np.pad(a, width, mode="reflect" if a.shape[axis] > max(before, after) else "symmetric")


def slide(a: np.ndarray, k: int, axis: int, op, fill) -> np.ndarray:
    """op (maximum or minimum) over k neighbours centred on each pixel, by doubling."""
    x = _pad(a, k // 2, k - 1 - k // 2, axis, "constant", fill)
    x = np.moveaxis(x, axis, -1)
    span = 1
    while span * 2 <= k:
        x = op(x[..., :-span], x[..., span:])
        span *= 2
    if rest := k - span:
        x = op(x[..., :-rest], x[..., rest:])
    return np.moveaxis(x, -1, axis)


def _limits(a: np.ndarray):
    return (False, True) if a.dtype == bool else (np.iinfo(a.dtype).min, np.iinfo(a.dtype).max) if a.dtype.kind in "iu" else (-np.inf, np.inf)


def dilate(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    lo = _limits(a)[0]
    return slide(slide(a, kx, 1, np.maximum, lo), ky, 0, np.maximum, lo)


def erode(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    hi = _limits(a)[1]
    return slide(slide(a, kx, 1, np.minimum, hi), ky, 0, np.minimum, hi)


def close(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return erode(dilate(a, kx, ky), kx, ky)


def open_(a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return dilate(erode(a, kx, ky), kx, ky)


def _disc(a: np.ndarray, k: int, op, fill) -> np.ndarray:
    """op over a disc of diameter k: rows of it are ranges of their own width."""
    r = k // 2
    x = _pad(a, r, r, 0, "constant", fill)
    out = None
    for dy in range(-r, r + 1):
        w = 2 * int(round(r * np.sqrt(max(0.0, 1 - (dy / max(r, 1)) ** 2)))) + 1
        part = slide(x[dy + r : dy + r + a.shape[0]], w, 1, op, fill)
        out = part if out is None else op(out, part)
    return out


def close_disc(a: np.ndarray, k: int) -> np.ndarray:
    lo, hi = _limits(a)
    return _disc(_disc(a, k, np.maximum, lo), k, np.minimum, hi)


def gaussian(a: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    n = size or odd(6 * sigma + 1)
    x = np.arange(n) - n // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    out = a.astype(np.float32)
    for axis in (0, 1):
        p, size_now = _pad(out, n // 2, n // 2, axis, "reflect"), a.shape[axis]
        view = lambda i: p[i : i + size_now] if axis == 0 else p[:, i : i + size_now]  # noqa: E731, B023
        out = view(n // 2) * np.float32(w[n // 2])
        part = np.empty_like(out)
        for i in range(n // 2):  # the weights are symmetric
            np.add(view(i), view(n - 1 - i), out=part)
            part *= np.float32(w[i])
            out += part
    return out


def box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over k x k windows centred on each pixel, by an integral image with reflected borders."""
    p = _pad(_pad(a.astype(np.float64), k // 2, k // 2, 0, "reflect"), k // 2, k // 2, 1, "reflect")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def sauvola(a: np.ndarray, window: int, k: float, r: float = 127.5) -> np.ndarray:
    n = window * window
    mean = box_sums(a, window) / n
    var = box_sums(a.astype(np.float64) ** 2, window) / n - mean**2
    return mean * (1 + k * (np.sqrt(np.maximum(var, 0)) / r - 1))


def otsu(values: np.ndarray) -> int:
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    w0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 0)
    return int(between.argmax())


def equalise(a: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation with bilinear blending of tiles."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = _pad(_pad(a, 0, th * tiles - h, 0, "reflect"), 0, tw * tiles - w, 1, "reflect")
    limit = max(1, int(clip * th * tw / 256))
    lut = np.zeros((tiles, tiles, 256), np.float32)
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + extra // 256
            if rest := extra % 256:
                n[:: max(1, 256 // rest)][:rest] += 1
            lut[i, j] = np.clip(np.round(n.cumsum() * 255.0 / (th * tw)), 0, 255)

    def weights(n: int, size: int):
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), (at - low).astype(np.float32)

    y0, y1, fy = weights(h, th)
    x0, x1, fx = weights(w, tw)
    at = lambda y, x: lut[y[:, None], x[None, :], a]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.clip(np.round(top * (1 - fy[:, None]) + low * fy[:, None]), 0, 255).astype(np.uint8)


def shrink(img: np.ndarray, longest: int) -> tuple[np.ndarray, float]:
    """Area-weighted reduction to a longest side; never enlarges."""
    h, w = img.shape[:2]
    scale = min(1.0, longest / max(h, w))
    if scale == 1.0:
        return img, 1.0
    out = img.astype(np.float32)
    for axis, n in ((0, h), (1, w)):
        m = max(1, int(round(n * scale)))
        c = np.concatenate([np.zeros_like(np.take(out, [0], axis)), out.cumsum(axis, dtype=np.float64)], axis)
        edge = np.arange(m + 1) * (n / m)
        lo = np.minimum(edge.astype(int), n)
        part = np.moveaxis(np.take(c, lo, axis), axis, 0)
        step = np.moveaxis(np.take(out, np.minimum(lo, n - 1), axis), axis, 0)
        full = part + step * (edge - lo).reshape(-1, *[1] * (out.ndim - 1))
        out = np.moveaxis(np.diff(full, axis=0) / (n / m), 0, axis).astype(np.float32)
    return np.clip(np.round(out), 0, 255).astype(np.uint8), scale


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.round(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def lab(bgr: np.ndarray) -> np.ndarray:
    """8-bit Lab: L scaled to 255, a and b offset by 128."""
    level = np.arange(256, dtype=np.float32) / 255
    c = np.where(level <= 0.04045, level / 12.92, ((level + 0.055) / 1.055) ** 2.4)[bgr[..., ::-1]]
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]], np.float32).T
    f = xyz / np.array([0.950456, 1.0, 1.088754], np.float32)
    f = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of n items is tied to by pairs (a, b)."""
    boss = np.arange(n)
    while True:
        x, y = boss[a], boss[b]
        open_ = x != y
        if not open_.any():
            return boss
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(boss, np.maximum(x, y), np.minimum(x, y))
        while (boss[boss] != boss).any():
            boss = boss[boss]


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, stats): 8-connected components by runs; stats rows are x, y, w, h, area, and label i is row i - 1."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    d = np.diff(flat, axis=1)
    y, start = np.nonzero(d == 1)
    end = np.nonzero(d == -1)[1]
    # runs of neighbouring rows that touch, also at corners: for each run a range of those in the row above
    key = w + 2
    first = np.searchsorted(y * key + end, (y - 1) * key + start)
    last = np.searchsorted(y * key + start, (y - 1) * key + end, side="right")
    many = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(y)), many)
    above = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    roots = _roots(len(y), above, below)
    _, number = np.unique(roots, return_inverse=True)
    n = int(number.max(initial=-1)) + 1
    stats = np.zeros((n, 5), np.int64)
    low = lambda v: (lambda o: (np.minimum.at(o, number, v), o)[1])(np.full(n, 1 << 40))
    high = lambda v: (lambda o: (np.maximum.at(o, number, v), o)[1])(np.zeros(n, int))
    stats[:, 0], stats[:, 1] = low(start), low(y)
    stats[:, 2], stats[:, 3] = high(end) - stats[:, 0], high(y) + 1 - stats[:, 1]
    stats[:, 4] = np.bincount(number, weights=end - start, minlength=n)
    labels = np.zeros((h, w + 1), np.int64)
    np.add.at(labels, (y, start), number + 1)
    np.add.at(labels, (y, end), -(number + 1))
    return labels.cumsum(axis=1)[:, :-1], stats


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border becomes foreground."""
    labels, _ = components(np.pad(~mask, 1, constant_values=True))
    return labels[1:-1, 1:-1] != labels[0, 0]


def min_area_rect(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, angle) of the least-area rectangle round the points: an edge of their hull lies on it."""
    # of each row only the outermost points can be corners of the hull
    rows = np.unique(y)
    at = np.searchsorted(rows, y)
    left, right = np.full(len(rows), x.max()), np.full(len(rows), x.min())
    np.minimum.at(left, at, x)
    np.maximum.at(right, at, x)
    pts = sorted({*zip(left.tolist(), rows.tolist(), strict=True), *zip(right.tolist(), rows.tolist(), strict=True)})
    hull: list = []
    for seq in (pts, pts[::-1]):
        part: list = []
        for p in seq:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        hull += part[:-1] or part
    p = np.array(hull, float)
    edge = np.roll(p, -1, axis=0) - p
    best = None
    for a in np.unique(np.arctan2(edge[:, 1], edge[:, 0]) % (np.pi / 2)):
        c, s = np.cos(a), np.sin(a)
        u, v = p @ (c, s), p @ (-s, c)
        w, h = np.ptp(u), np.ptp(v)
        if best is None or w * h < best[0]:
            m, n = (u.min() + u.max()) / 2, (v.min() + v.max()) / 2
            best = (w * h, m * c - n * s, m * s + n * c, w, h, np.degrees(a))
    return tuple(map(float, best[1:]))


def rotate(img: np.ndarray, angle: float, fill, nearest: bool = False) -> np.ndarray:
    """Turned by angle degrees about the centre on the same canvas."""
    h, w = img.shape[:2]
    a = np.radians(angle)
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    x, y = x - w / 2, y - h / 2
    sx, sy = np.cos(a) * x - np.sin(a) * y + w / 2, np.sin(a) * x + np.cos(a) * y + h / 2
    p = np.pad(img, [(1, 1), (1, 1)] + [(0, 0)] * (img.ndim - 2))
    p[[0, -1]] = fill
    p[:, [0, -1]] = fill
    if nearest:
        return p[np.clip(np.round(sy).astype(int) + 1, 0, h + 1), np.clip(np.round(sx).astype(int) + 1, 0, w + 1)]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0), (sy - y0)
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    at = lambda yy, xx: p[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)].astype(np.float32)
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.round(out), 0, 255).astype(np.uint8)
