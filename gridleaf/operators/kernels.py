"""Array kernels for whole page images.  No Spark here; ``detect`` maps them over pages.

Images are 8-bit arrays (height, width) or (height, width, 3) in blue, green, red order;
masks hold 0 and 255.
"""

from __future__ import annotations

import numpy as np


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    b, g, r = (image[:, :, i].astype(np.int32) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def otsu_threshold(gray: np.ndarray) -> int:
    """The first level of greatest variance between the classes (Otsu 1979)."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    level = np.flatnonzero(n)
    w0, s0 = np.cumsum(n[level]), np.cumsum(n[level] * level)
    rest = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = s0 / w0 - (s0[-1] - s0) / rest
        between = np.where(rest > 0, w0 * rest * apart * apart, 0.0)
    return int(level[np.argmax(between)])


def binarize(gray: np.ndarray) -> np.ndarray:
    """Dark pixels become 255."""
    return np.where(gray > otsu_threshold(gray), 0, 255).astype(np.uint8)


def _window_counts(mask: np.ndarray, axis: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Ink, and pixels at all, under a window along an axis that ends at the image's edges."""
    ink = (mask > 0).astype(np.int32)
    total = np.insert(np.cumsum(ink, axis=axis), 0, 0, axis=axis)
    n = mask.shape[axis]
    low, high = np.maximum(np.arange(n) - before, 0), np.minimum(np.arange(n) + after + 1, n)
    high = np.maximum(high, low)
    shape = [1, 1]
    shape[axis] = n
    return np.take(total, high, axis=axis) - np.take(total, low, axis=axis), (high - low).reshape(shape)


def _reach(size: int, iterations: int) -> tuple[int, int]:
    before = size // 2 * iterations
    return before, (size - 1) * iterations - before


def erode_line(mask: np.ndarray, axis: int, size: int, iterations: int = 1) -> np.ndarray:
    ink, all_of = _window_counts(mask, axis, *_reach(size, iterations))
    return np.where(ink == all_of, 255, 0).astype(np.uint8)


def dilate_line(mask: np.ndarray, axis: int, size: int, iterations: int = 1) -> np.ndarray:
    return np.where(_window_counts(mask, axis, *_reach(size, iterations))[0] > 0, 255, 0).astype(np.uint8)


def open_line(mask: np.ndarray, axis: int, size: int, iterations: int = 1) -> np.ndarray:
    return dilate_line(erode_line(mask, axis, size, iterations), axis, size, iterations)


def dilate(mask: np.ndarray, width: int, height: int, iterations: int = 1) -> np.ndarray:
    return dilate_line(dilate_line(mask, 1, width, iterations), 0, height, iterations)


def close(mask: np.ndarray, width: int, height: int, iterations: int = 1) -> np.ndarray:
    grown = dilate(mask, width, height, iterations)
    return erode_line(erode_line(grown, 1, width, iterations), 0, height, iterations)


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1..n of connected ink (0: none), numbered in raster order of their first pixels."""
    height, width = mask.shape
    ink = np.zeros((height, width + 2), dtype=np.int8)
    ink[:, 1:-1] = mask > 0
    step = np.diff(ink, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]  # after the last pixel; runs come in the same order
    n = len(row)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(height + 1)).tolist()
    starts, stops, reach = start.tolist(), stop.tolist(), int(diagonal)
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        end_i, end_j = first[y], first[y + 1]
        while i < end_i and j < end_j:
            if starts[i] < stops[j] + reach and starts[j] < stops[i] + reach:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(n)], dtype=np.int64)
    names = np.unique(roots, return_inverse=True)
    labels = np.zeros((height, width), dtype=np.int32)
    for y, a, b, name in zip(row.tolist(), starts, stops, (names[1] + 1).tolist(), strict=True):
        labels[y, a:b] = name
    return labels, len(names[0])


def boxes_of(labels: np.ndarray, n: int) -> np.ndarray:
    """(n, 5): x, y, width, height, pixels of each label."""
    y, x = np.nonzero(labels)
    at = labels[y, x] - 1
    out = np.zeros((n, 5), dtype=np.int64)
    if not n:
        return out
    big = np.iinfo(np.int64).max
    low_x, low_y, high_x, high_y = np.full(n, big), np.full(n, big), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(low_x, at, x)
    np.minimum.at(low_y, at, y)
    np.maximum.at(high_x, at, x)
    np.maximum.at(high_y, at, y)
    return np.stack([low_x, low_y, high_x - low_x + 1, high_y - low_y + 1, np.bincount(at, minlength=n)], axis=1)


#: Steps around a pixel, clockwise from the right (y grows downwards).
_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _trace(labels: np.ndarray, label: int, x: int, y: int) -> list[tuple[int, int]]:
    """The outer border of a label from its first pixel in raster order (Moore neighbours)."""
    height, width = labels.shape

    def inside(px: int, py: int) -> bool:
        return 0 <= px < width and 0 <= py < height and labels[py, px] == label

    points, at, came = [(x, y)], (x, y), 4  # the pixel to the left is outside
    first_move = None
    while True:
        for turn in range(1, 9):
            way = (came + turn) % 8
            after = (at[0] + _AROUND[way][0], at[1] + _AROUND[way][1])
            if inside(*after):
                break
        else:
            return points  # a single pixel
        if (at, after) == first_move:
            return points[:-1] if points[-1] == points[0] and len(points) > 1 else points
        if first_move is None:
            first_move = (at, after)
        points.append(after)
        # The outside neighbour that was looked at before, seen from the new pixel.
        back = (at[0] + _AROUND[(way - 1) % 8][0] - after[0], at[1] + _AROUND[(way - 1) % 8][1] - after[1])
        came, at = _AROUND.index(back), after


def external_contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders (n, 2) as x, y of components that lie in no hole of another."""
    labels, n = components(mask)
    if not n:
        return []
    padded = np.pad(labels == 0, 1, constant_values=True)
    outside, _ = components(np.where(padded, 255, 0), diagonal=False)
    sea = outside == outside[0, 0]
    flat = labels.ravel()
    firsts = np.full(n + 1, -1, dtype=np.int64)
    at = np.flatnonzero(flat)
    firsts[flat[at[::-1]]] = at[::-1]
    out = []
    for label in range(1, n + 1):
        y, x = divmod(int(firsts[label]), labels.shape[1])
        if sea[y + 1, x]:  # what is left of the first pixel belongs to the outside
            out.append(np.array(_trace(labels, label, x, y), dtype=np.int64))
    return out


def polygon_area(points: np.ndarray) -> float:
    """Area inside a polygon through pixel centres."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0].astype(np.float64), points[:, 1].astype(np.float64)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def perimeter(points: np.ndarray) -> float:
    if len(points) < 2:
        return 0.0
    return float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum())


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """A closed polygon whose border stays within ``eps`` of the points (Douglas and Peucker 1973).

    The two anchors are far apart: from the first point three times the farthest point is taken.
    """
    n = len(points)
    if n < 3:
        return points
    a = 0
    for _ in range(3):
        b = int(np.argmax(((points - points[a]) ** 2).sum(axis=1)))
        a, b = b, a
    if a == b or (points[a] == points[b]).all():
        return points[a : a + 1]
    a, b = min(a, b), max(a, b)
    keep = {a, b}
    stack = [(a, b), (b, a + n)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        between = points[np.arange(i + 1, j) % n].astype(np.float64)
        p, q = points[i % n].astype(np.float64), points[j % n].astype(np.float64)
        d = q - p
        length = np.hypot(*d)
        away = np.hypot(*(between - p).T) if length == 0 else np.abs(d[0] * (between[:, 1] - p[1]) - d[1] * (between[:, 0] - p[0])) / length
        far = int(np.argmax(away))
        if away[far] > eps:
            keep.add((i + 1 + far) % n)
            stack += [(i, i + 1 + far), (i + 1 + far, j)]
    return points[sorted(keep)]


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    """Weights of an odd window; without sigma one that suits the size."""
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma**2))
    return weights / weights.sum()


def _mirror(values: np.ndarray, reach: int, axis: int) -> np.ndarray:
    widths = [(0, 0)] * values.ndim
    widths[axis] = (reach, reach)
    return np.pad(values, widths, mode="reflect" if values.shape[axis] > reach else "symmetric")


def gaussian_blur(gray: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    if size <= 1 and sigma <= 0:
        return gray
    if size <= 0:
        size = int(round(sigma * 6 + 1)) | 1
    weights, reach = gaussian_kernel(size, sigma), size // 2
    out = gray.astype(np.float64)
    for axis in (0, 1):
        padded = _mirror(out, reach, axis)
        n = out.shape[axis]
        out = sum(w * np.take(padded, np.arange(i, i + n), axis=axis) for i, w in enumerate(weights))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    v = gray.astype(np.float64)
    p = np.pad(v, 1, mode="reflect") if min(v.shape) > 1 else np.pad(v, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * v
    return float(lap.var())


def contrast(gray: np.ndarray) -> float:
    mean = float(gray.mean())
    return 0.0 if mean == 0 else min(float(gray.std()) / mean, 1.0)


def adaptive_threshold(gray: np.ndarray, size: int = 35, less: int = 11) -> np.ndarray:
    """255 where a pixel exceeds the Gaussian mean around it less a constant."""
    return np.where(gray.astype(np.int32) > gaussian_blur(gray, size).astype(np.int32) - less, 255, 0).astype(np.uint8)


def unsharp_mask(image: np.ndarray, amount: float = 1.0, radius: float = 1.0) -> np.ndarray:
    channels = [image] if image.ndim == 2 else [image[:, :, i] for i in range(image.shape[2])]
    done = [np.clip(np.rint((1 + amount) * c.astype(np.float64) - amount * gaussian_blur(c, 0, radius)), 0, 255).astype(np.uint8) for c in channels]
    return done[0] if image.ndim == 2 else np.stack(done, axis=2)


def auto_gamma(image: np.ndarray, target: float = 0.5) -> np.ndarray:
    mean = np.clip(to_gray(image).mean() / 255.0, 1e-3, 0.999)
    gamma = np.clip(np.log(target) / np.log(mean), 0.6, 1.6)
    return np.clip((np.arange(256) / 255.0) ** gamma * 255.0, 0, 255).astype(np.uint8)[image]


def median3(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([p[y : y + h, x : x + w] for y in range(3) for x in range(3)]), axis=0).astype(np.uint8)


def sharpen(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray.astype(np.int32), 1, mode="reflect")
    h, w = gray.shape
    near = sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3))
    return np.clip(10 * gray.astype(np.int32) - near, 0, 255).astype(np.uint8)


def clahe(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Local histogram equalization with a contrast limit, blended between tile centres (Zuiderveld 1994)."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if h > th * tiles - h and w > tw * tiles - w else "edge")
    limit = max(1, int(clip * th * tw / 256))
    curves = np.empty((tiles, tiles, 256))
    for ty in range(tiles):
        for tx in range(tiles):
            n = np.bincount(p[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            n[: over % 256] += 1
            curves[ty, tx] = np.clip(np.cumsum(n) * (255.0 / (th * tw)), 0, 255)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    ys, xs = [np.clip(y0 + d, 0, tiles - 1)[:, None] for d in (0, 1)], [np.clip(x0 + d, 0, tiles - 1)[None, :] for d in (0, 1)]
    top = curves[ys[0], xs[0], gray] * (1 - ax) + curves[ys[0], xs[1], gray] * ax
    low = curves[ys[1], xs[0], gray] * (1 - ax) + curves[ys[1], xs[1], gray] * ax
    return np.clip(np.rint(top * (1 - ay) + low * ay), 0, 255).astype(np.uint8)


#: Linear sRGB (blue, green, red) to CIE XYZ over the D65 white point: fixed values of the standard.
_XYZ = np.array([[0.180423, 0.357580, 0.412453], [0.072169, 0.715160, 0.212671], [0.950227, 0.119193, 0.019334]]) / np.array([[0.950456], [1.0], [1.088754]])


def to_lab(image: np.ndarray) -> np.ndarray:
    """CIE L*, a*, b* of a blue, green, red image, as floats."""
    v = image.astype(np.float64) / 255.0
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = linear @ _XYZ.T
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[:, :, 1] - 16, 500 * (f[:, :, 0] - f[:, :, 1]), 200 * (f[:, :, 1] - f[:, :, 2])], axis=2)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[:, :, 0] + 16) / 116
    f = np.stack([y + lab[:, :, 1] / 500, y, y - lab[:, :, 2] / 200], axis=2)
    t = np.where(f**3 > 216 / 24389, f**3, (116 * f - 16) * 27 / 24389)
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    v = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(v * 255), 0, 255).astype(np.uint8)


def clahe_color(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """``clahe`` on the lightness L* (as 0 to 255); a* and b* stay."""
    lab = to_lab(image)
    lab[:, :, 0] = clahe(np.rint(np.clip(lab[:, :, 0] * 2.55, 0, 255)).astype(np.uint8), clip, tiles) / 2.55
    return from_lab(lab)


def denoise_tv(gray: np.ndarray, weight: float = 1.0, iterations: int = 1) -> np.ndarray:
    """Total-variation denoising with an L1 data term by primal-dual steps (Chambolle and Pock 2011)."""
    f = gray.astype(np.float64) / 255.0
    u, bar = f.copy(), f.copy()
    px, py = np.zeros_like(f), np.zeros_like(f)
    sigma = tau = 1 / np.sqrt(8.0)
    for _ in range(iterations):
        px[:, :-1] += sigma * np.diff(bar, axis=1)
        py[:-1] += sigma * np.diff(bar, axis=0)
        norm = np.maximum(1.0, np.hypot(px, py))
        px, py = px / norm, py / norm
        spread = np.diff(px, axis=1, prepend=0) + np.diff(py, axis=0, prepend=0)
        v = u + tau * spread - f
        after = f + np.sign(v) * np.maximum(np.abs(v) - tau * weight, 0)
        u, bar = after, 2 * after - u
    return np.clip(np.rint(u * 255), 0, 255).astype(np.uint8)


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counter-clockwise about the middle, same size, bilinear, edges repeated."""
    h, w = gray.shape
    t = np.deg2rad(degrees)
    cos, sin, cx, cy = np.cos(t), np.sin(t), w / 2, h / 2
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    sx = cos * (x - cx) - sin * (y - cy) + cx
    sy = sin * (x - cx) + cos * (y - cy) + cy
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    ax, ay = sx - x0, sy - y0
    v = gray.astype(np.float64)
    out = (v[y0, x0] * (1 - ax) + v[y0, x1] * ax) * (1 - ay) + (v[y1, x0] * (1 - ax) + v[y1, x1] * ax) * ay
    return np.rint(out).astype(np.uint8)


def skew_angle(gray: np.ndarray, most: float = 10.0, step: float = 0.1) -> float:
    """The turn, in degrees, that makes ink fall into the sharpest rows; 0 without ink.

    Votes of ink edges over row positions for each angle (a Hough transform restricted to
    near-horizontal lines, Duda and Hart 1972); of equal angles the smallest.
    """
    mask = binarize(gray) > 0 if gray.min() < gray.max() else np.zeros(gray.shape, dtype=bool)
    edge = mask.copy()
    edge[1:] &= ~mask[:-1]  # upper edges only
    y, x = np.nonzero(edge)
    if len(y) < 2:
        return 0.0
    best, found = -1.0, 0.0
    for degrees in sorted(np.arange(-most, most + step / 2, step), key=lambda d: (round(abs(d), 6), d)):
        at = np.rint(y - x * np.tan(np.deg2rad(degrees))).astype(np.int64)
        votes = float((np.bincount(at - at.min()).astype(np.float64) ** 2).sum())
        if votes > best * (1 + 1e-12):
            best, found = votes, float(degrees)
    return round(found, 6) + 0.0
