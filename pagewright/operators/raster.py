"""Raster operators on numpy pictures, and their Arrow column function.

A picture is (h, w) or (h, w, 3) of 0 to 255; borders mirror without repeating the edge. Filters with free choices (edge
linking, contour tracing, denoising weights) follow their published definitions and are not bit-equal to any library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PICTURE = "struct<h:int,w:int,channels:int,data:array<double>>"
PICTURE_TYPE = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("data", pa.list_(pa.float64()))])


def padded(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Mirrored borders of any width, even beyond a small picture's size."""

    def index(n: int, r: int) -> np.ndarray:
        if n == 1:
            return np.zeros(n + 2 * r, np.int64)
        i = np.abs(np.arange(-r, n + r)) % (2 * n - 2)
        return np.where(i < n, i, 2 * n - 2 - i)

    return a[index(a.shape[0], ry)][:, index(a.shape[1], rx)]


def kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    """A Gaussian; without sigma it follows from the size, without a size the size from sigma."""
    if size <= 0:
        size = int(round(sigma * 8 + 1)) | 1
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def separable(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    r = len(k) // 2
    p = padded(a.astype(np.float64), r, r)
    rows = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + a.shape[1]] for i, w in enumerate(k))


def blur(a: np.ndarray, size: int = 0, sigma: float = 0.0) -> np.ndarray:
    return separable(a, kernel(size, sigma))


def bytes_of(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255)


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else bytes_of(a @ np.array([0.299, 0.587, 0.114]))


def extremes(a: np.ndarray, ky: int, kx: int, least: bool) -> np.ndarray:
    """Least or greatest value in a window; beyond the borders nothing counts."""
    ry, rx = ky // 2, kx // 2
    p = np.pad(a.astype(np.float64), ((ry, ky - 1 - ry), (rx, kx - 1 - rx)), constant_values=np.inf if least else -np.inf)
    pick = np.minimum if least else np.maximum
    out = p[: a.shape[0], : a.shape[1]].copy()
    for i in range(ky):
        for j in range(kx):
            pick(out, p[i : i + a.shape[0], j : j + a.shape[1]], out=out)
    return out


def adaptive(a: np.ndarray, block: int, c: float, gaussian: bool, inverse: bool) -> np.ndarray:
    mean = bytes_of(separable(a, kernel(block) if gaussian else np.full(block, 1 / block)))
    lit = a > mean - c
    return np.where(lit ^ inverse, 255.0, 0.0)


def black_and_white(a: np.ndarray) -> np.ndarray:
    return adaptive(grey(a), 25, 15, True, False)


def lines(binary: np.ndarray, ky: int, kx: int) -> np.ndarray:
    """What is left of lit pixels after opening by a long kernel: ruled lines."""
    return extremes(extremes(binary, ky, kx, True), ky, kx, False)


def middles(hits: np.ndarray) -> list[int]:
    """The middle of each run of hits."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hits.astype(np.int8), [0]])))
    return [int(a + b - 1) // 2 for a, b in zip(edges[::2], edges[1::2])]


def ruled_boundaries(a: np.ndarray, share: float = 0.5) -> tuple[list[int], list[int]]:
    """Places of ruled lines, rows and columns: dark strokes that fill at least half of the picture's width or height."""
    ink = adaptive(grey(a), 15, 10, False, True)
    h, w = ink.shape
    rows, cols = lines(ink, 1, max(15, w // 20)), lines(ink, max(15, h // 20), 1)
    return middles((rows > 0).sum(1) >= w * share), middles((cols > 0).sum(0) >= h * share)


def even_light(a: np.ndarray) -> np.ndarray:
    k = min(a.shape[:2]) // 8
    k = max(31, k + (k % 2 == 0))
    return bytes_of(np.minimum(a * 255.0 / (blur(a, k) + 1), 255))


#: Pixels of shifted pictures that denoising works on at a time: rows of shifts of small pictures, up to one row if it has
#: at most the second number, else a single shift.
SHIFTED, ROW_OF_SHIFTS = 1 << 16, 1 << 20


def run_sums(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Sums of n successive values along an axis, by doubling."""
    m, at, size, out = a.shape[axis] - n + 1, 0, 1, None
    part = lambda x, begin, end: x[(slice(None),) * (axis % x.ndim) + (slice(begin, end),)]
    while n:
        if n & 1:
            out = part(a, at, at + m) if out is None else out + part(a, at, at + m)
            at += size
        n >>= 1
        if n:
            a = part(a, 0, -size) + part(a, size, None)
            size *= 2
    return out


def denoised(a: np.ndarray, strength: float = 6.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every pixel becomes the mean of those around it whose patches look alike."""
    a = a.astype(np.float64)
    r, pr = search // 2, patch // 2
    h, w = a.shape[:2]
    planes = np.ascontiguousarray((a if a.ndim == 3 else a[..., None]).transpose(2, 0, 1))
    place = lambda n, k: padded(np.arange(n)[:, None], k, 0)[:, 0]
    wide = planes[:, place(h, r + pr)][:, :, place(w, r + pr)]
    # distances of whole numbers of bytes stay below 2^24, so they are exact in single precision too
    exact = len(planes) * patch**2 * 255**2 < 1 << 24 and bool(((a >= 0) & (a <= 255) & (a == np.rint(a))).all())
    far = wide.astype(np.float32) if exact else wide
    own = far[:, r : r + h + 2 * pr, r : r + w + 2 * pr, None, None]
    around = lambda x: np.lib.stride_tricks.sliding_window_view(x, (search, search), axis=(1, 2))
    shifts, values = around(far), around(wide[:, pr : pr + h + 2 * r, pr : pr + w + 2 * r])
    total, weights = np.zeros_like(planes), np.zeros((h, w))
    across = search if own[0].size * search <= ROW_OF_SHIFTS else 1
    down = max(1, SHIFTED // (own[0].size * search))
    for y in range(0, search, down):
        for x in range(0, search, across):
            d: np.ndarray | float = 0.0
            for mine, other in zip(own, shifts[..., y : y + down, x : x + across]):
                apart = mine - other
                d = np.multiply(apart, apart, out=apart) + d
            weight = run_sums(run_sums(d, patch, 0), patch, 1).astype(np.float64)
            weight = np.exp(weight / (-(strength**2) * patch**2 * len(planes)))
            total += np.einsum("ijst,cijst->cij", weight, values[..., y : y + down, x : x + across])
            weights += weight.sum((2, 3))
    out = bytes_of(total / weights)
    return out[0] if a.ndim == 2 else out.transpose(1, 2, 0)


def clahe(a: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Equalisation by tiles with clipped histograms; between tile centres the mappings are interpolated."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric") if h > 1 and w > 1 else np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    if not ((full >= 0) & (full < 256)).all():
        raise ValueError("numbers beyond those of bytes")
    limit = max(1, int(clip * th * tw / 256))
    tile = np.arange(th * tiles)[:, None] // th * tiles + np.arange(tw * tiles) // tw
    counts = np.bincount((tile * 256 + full.astype(np.int64)).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    over = np.maximum(counts - limit, 0).sum(1)[:, None]
    counts = np.minimum(counts, limit) + over // 256 + (np.arange(256) < over % 256)
    maps = np.clip(np.rint(counts.cumsum(1) * 255.0 / (th * tw)), 0, 255).reshape(tiles, tiles, 256)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y), 0, tiles - 1).astype(int), np.clip(np.floor(x), 0, tiles - 1).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    v = a.astype(np.int64)
    pick = lambda p, q: maps[p[:, None], q[None, :], v]
    return np.rint((1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1)))


TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE_POINT = np.array([0.950456, 1.0, 1.088754])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    f = (linear @ TO_XYZ.T) / WHITE_POINT
    f = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * WHITE_POINT
    linear = np.clip(xyz @ np.linalg.inv(TO_XYZ).T, 0, None)
    return bytes_of(255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear))


def contrast(a: np.ndarray, clip: float = 2.5) -> np.ndarray:
    if a.ndim == 2:
        return clahe(a, clip)
    lab = to_lab(a)
    lab[..., 0] = clahe(np.rint(lab[..., 0] * 2.55), clip) / 2.55
    return from_lab(lab)


def sharpened(a: np.ndarray, amount: float = 1.5) -> np.ndarray:
    return bytes_of((1 + amount) * a - amount * bytes_of(blur(a, 0, 3.0)))


def resized(a: np.ndarray, h: int, w: int, lobes: int = 0) -> np.ndarray:
    """Bilinear, or Lanczos with so many lobes; pixel centres map to pixel centres."""

    def weights(n: int, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        d = at[:, None] - np.arange(n)[None, :]
        reach = lobes or 1
        k = np.where(np.abs(d) < reach, np.sinc(d) * np.sinc(d / reach) if lobes else 1 - np.abs(d), 0)
        k[:, 0] += np.where((at < 0) & (lobes == 0), np.abs(at), 0)
        k[:, -1] += np.where((at > n - 1) & (lobes == 0), at - (n - 1), 0)
        return k / k.sum(1, keepdims=True)

    tall = np.tensordot(weights(a.shape[0], h), a.astype(np.float64), 1)
    return bytes_of(np.moveaxis(np.tensordot(weights(a.shape[1], w), tall, (1, 1)), 0, 1))


def upscaled(a: np.ndarray, factor: float = 2.0) -> np.ndarray:
    big = resized(a, int(a.shape[0] * factor), int(a.shape[1] * factor), 4)
    return bytes_of(1.3 * big - 0.3 * bytes_of(blur(big, 0, 2.0)))


def enhanced(a: np.ndarray, intensity: float = 1.0) -> np.ndarray:
    return sharpened(contrast(denoised(even_light(a)), 2.5 * intensity), 1.2 * intensity)


def edges(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny: gradient maxima over the high threshold, and those over the low one that are connected to them."""
    p = padded(a.astype(np.float64), 1, 1)
    h, w = a.shape
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    g = np.abs(gx) + np.abs(gy)
    q = np.pad(g, 1)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    way = np.rint(angle / 45).astype(int) % 4
    dy, dx = np.array([0, 1, 1, 1])[way], np.array([1, 1, 0, -1])[way]
    yy, xx = np.mgrid[1 : h + 1, 1 : w + 1]
    top = (g > q[yy - dy, xx - dx]) & (g >= q[yy + dy, xx + dx])
    strong, weak = top & (g > high), top & (g > low)
    runs, label = labelled(weak)
    begins = np.concatenate([[0], np.cumsum(strong.ravel())])
    lit = np.zeros(len(label), bool)
    np.logical_or.at(lit, label, begins[runs[:, 0] * w + runs[:, 2]] > begins[runs[:, 0] * w + runs[:, 1]])
    steps = np.zeros(h * w + 1, np.int32)
    kept = runs[lit[label]]
    np.add.at(steps, kept[:, 0] * w + kept[:, 1], 1)
    np.add.at(steps, kept[:, 0] * w + kept[:, 2], -1)
    return np.where(np.cumsum(steps[:-1]).reshape(h, w) > 0, 255.0, 0.0)


def labelled(lit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (y, first x, end x) of lit pixels in scanning order, and for each the number of the first run of its group of
    neighbouring pixels, corners included. Runs are matched by search and united, so the work goes by runs and not by pixels."""
    h, w = lit.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = lit
    change = np.diff(flat.ravel())
    first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    runs = np.stack([first // (w + 2), first % (w + 2), end % (w + 2)], 1) if len(first) else np.empty((0, 3), np.int64)
    above = runs[:, 0] - 1
    low = np.searchsorted(end, above * (w + 2) + runs[:, 1], "left")
    high = np.searchsorted(first, above * (w + 2) + runs[:, 2], "right")
    up = list(range(len(runs)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in np.flatnonzero(high > low).tolist():
        for j in range(low[i], high[i]):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
    return runs, np.array([root(i) for i in range(len(runs))], np.int64)


AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def components(lit: np.ndarray) -> list[np.ndarray]:
    """Pixels (y, x) of each group of neighbouring lit pixels, groups and pixels in scanning order."""
    runs, label = labelled(lit)
    order = np.argsort(label, kind="stable")
    sizes = (runs[:, 2] - runs[:, 1])[order]
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    pixels = np.stack([np.repeat(runs[order, 0], sizes), np.repeat(runs[order, 1], sizes) + within], 1)
    borders = np.flatnonzero(np.diff(label[order])) + 1
    return np.split(pixels, ends[borders - 1]) if len(pixels) else []


def outline(group: np.ndarray) -> np.ndarray:
    """Outer border (x, y) of a component, clockwise from its first pixel (Moore's tracing)."""
    low = group.min(0) - 1
    h, w = group.max(0) - low + 2
    mask = np.zeros((h, w), np.uint8)
    mask[tuple((group - low).T)] = 1
    lit, steps = mask.tobytes(), [dy * int(w) + dx for dy, dx in AROUND]
    start = at = lit.index(1)
    came, out = 6, [start]
    for _ in range(4 * len(group) + 8):
        for k in range(1, 9):
            d = (came + k) % 8
            if lit[at + steps[d]]:
                at, came = at + steps[d], (d + 4) % 8
                break
        else:
            break
        if at == start:
            break
        out.append(at)
    places = np.array(out)
    return np.stack([places % w + low[1], places // w + low[0]], 1).astype(np.float64)


def simplified(points: np.ndarray, reach: float) -> np.ndarray:
    """A closed line without the points that are nearer than reach to the rest (Douglas and Peucker)."""

    def open_line(p: np.ndarray) -> list:
        if len(p) < 3:
            return p.tolist()
        a, b = p[0], p[-1]
        n = np.hypot(*(b - a))
        d = np.abs((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])) / n if n else np.hypot(*(p - a).T)
        i = int(d.argmax())
        return open_line(p[: i + 1])[:-1] + open_line(p[i:]) if d[i] > reach else [a.tolist(), b.tolist()]

    if len(points) < 3:
        return points
    far = int(np.hypot(*(points - points[0]).T).argmax())
    far = int(np.hypot(*(points - points[far]).T).argmax()), far
    i, j = sorted(far)
    return np.array(open_line(points[i : j + 1])[:-1] + open_line(np.vstack([points[j:], points[: i + 1]]))[:-1])


def polygon_area(p: np.ndarray) -> float:
    return abs(float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())) / 2


def page_corners(a: np.ndarray, least: float = 0.15) -> list[list[float]] | None:
    """Corners of the largest outline of four corners, top left first and clockwise; None if there is none."""
    found = extremes(edges(blur(grey(a), 5), 60, 160), 3, 3, False)
    best, best_area = None, 0.0
    for group in components(found > 0):
        line = outline(group)
        size = polygon_area(line)
        if size < least * a.shape[0] * a.shape[1]:
            continue
        around = float(np.hypot(*(line - np.roll(line, -1, 0)).T).sum())
        quad = simplified(line, 0.02 * around)
        if len(quad) == 4 and size > best_area:
            best, best_area = quad, size
    if best is None:
        return None
    add, sub = best.sum(1), best[:, 1] - best[:, 0]
    last = lambda k: len(k) - 1 - int(k[::-1].argmax())
    return [best[i].tolist() for i in (int(add.argmin()), int(sub.argmin()), last(add), last(sub))]


def warped(a: np.ndarray, corners: list[list[float]]) -> np.ndarray:
    """The quad of the corners as a flat picture."""
    c = np.array(corners)
    w, h = max(np.hypot(*(c[1] - c[0])), np.hypot(*(c[2] - c[3]))), max(np.hypot(*(c[3] - c[0])), np.hypot(*(c[2] - c[1])))
    goal = np.array([[0, 0], [w, 0], [w, h], [0, h]])
    rows, right = [], []
    for (x, y), (u, v) in zip(goal, c):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    yy, xx = np.mgrid[0 : max(1, int(h)), 0 : max(1, int(w))]
    p = np.stack([xx, yy, np.ones_like(xx)], -1) @ m.T
    return sampled(a, p[..., 0] / p[..., 2], p[..., 1] / p[..., 2])


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at places; black beyond the picture."""
    h, w = a.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = 0
    for dy in (0, 1):
        for dx in (0, 1):
            inside = (x0 + dx >= 0) & (x0 + dx < w) & (y0 + dy >= 0) & (y0 + dy < h)
            weight = np.where(inside, np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0)), 0)
            v = a[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
            out = out + v * (weight if a.ndim == 2 else weight[..., None])
    return bytes_of(out)


def flattened(a: np.ndarray) -> np.ndarray:
    """A page whose curved upper and lower edges become straight; unchanged where no curve fits."""
    groups = components(edges(blur(grey(a), 5), 40, 120) > 0)
    if not groups:
        return a
    points = outline(max(groups, key=lambda g: polygon_area(outline(g))))
    h, w = a.shape[:2]
    x = np.clip(points[:, 0].astype(int), 0, w - 1)
    kinds = np.unique(x)
    if len(kinds) < 10:
        return a
    fits = [np.polyfit(kinds, [f(points[x == k, 1]) for k in kinds], 2) for f in (min, max)]
    top, bottom = (np.polyval(f, np.arange(w)) for f in fits)
    t = (np.arange(h)[:, None] - top.min()) / max(bottom.max() - top.min(), 1.0)
    return sampled(a, np.broadcast_to(np.arange(w, dtype=float), (h, w)), top + t * np.maximum(bottom - top, 1.0))


def tensor(a: np.ndarray, h: int, w: int, mean: tuple[float, ...], deviation: tuple[float, ...], pad_to: int = 0) -> np.ndarray:
    """Planes by channel of the resized and normalised picture; with pad_to zeros on the right and below."""
    rgb = a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
    planes = ((resized(rgb, h, w) / 255.0 - np.array(mean)) / np.array(deviation)).transpose(2, 0, 1)
    return np.pad(planes, ((0, 0), (0, pad_to - h), (0, pad_to - w))) if pad_to else planes


def box_regions(probability: np.ndarray, threshold: float = 0.3) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, mean probability) of the boxes of lit areas and of the holes in them."""
    lit = probability > threshold
    border = np.pad(~lit, 1, constant_values=True)
    groups = components(lit)
    groups += [g - 1 for g in components(border) if not (g == 0).any()]
    out = []
    for g in groups:
        (y0, x0), (y1, x1) = g.min(0), g.max(0)
        out.append((int(x0), int(y0), int(x1 - x0 + 1), int(y1 - y0 + 1), float(probability[y0 : y1 + 1, x0 : x1 + 1].mean())))
    return out


def rotated(a: np.ndarray, degrees: int) -> np.ndarray:
    return np.rot90(a, -(degrees // 90) % 4)


MODES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"original": lambda a: a, "grey": grey, "bw": black_and_white, "enhance": enhanced}


#: Numbers of pictures that become one Arrow array at a time; a picture of more is an array of its own.
NUMBERS = 1 << 19

FAILURES = (TypeError, ValueError, IndexError, np.linalg.LinAlgError)


def opened(batch: pa.StructArray) -> Iterator[np.ndarray | None]:
    """The pictures of an Arrow array, each a copy that is made when it is asked for; None for one that can't be read. Their
    numbers never become Python objects."""
    parts = dict(zip((f.name for f in batch.type), batch.flatten()))
    data = parts["data"]
    places, there = data.offsets.to_numpy().tolist(), data.is_valid().to_numpy(zero_copy_only=False).tolist()
    for i, shape in enumerate(zip(*(parts[k].to_pylist() for k in ("h", "w", "channels")))):
        try:
            numbers = data.values[places[i] : places[i + 1]].to_numpy(zero_copy_only=False)
            yield np.array(numbers, np.float64).reshape(shape[:2] if shape[2] == 1 else shape) if there[i] else None
        except (TypeError, ValueError):
            yield None


def packed(pictures: list[np.ndarray | None]) -> pa.StructArray:
    """Pictures as an Arrow array."""
    missing = np.array([y is None for y in pictures], bool)
    shapes = np.array([(0, 0, 0) if y is None else (*y.shape, 1)[:3] for y in pictures], np.int32).reshape(-1, 3)
    ends = np.cumsum([0, *(0 if y is None else y.size for y in pictures)])
    numbers = np.concatenate([np.empty(0), *(y.ravel() for y in pictures if y is not None)])
    data = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.float64()))
    return pa.StructArray.from_arrays([*(pa.array(k) for k in shapes.T), data], fields=list(PICTURE_TYPE), mask=pa.array(missing))


def applied(picture: Column, operation: Callable[[np.ndarray], np.ndarray]) -> Column:
    """operation on a column of pictures (h, w, channels, data), in parts of Arrow batches. A picture that can't be read, or
    on which the operation fails, gives null and not a failed task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, size = [], 0
            for a in opened(batch):
                try:
                    out.append(None if a is None else operation(a))
                except FAILURES:
                    out.append(None)
                size += 0 if out[-1] is None else out[-1].size
                if size >= NUMBERS:
                    yield packed(out)
                    out, size = [], 0
            yield packed(out)

    return F.arrow_udf(run, PICTURE)(picture)


def measured(picture: Column, measures: dict[str, Callable[[np.ndarray], float]]) -> Column:
    """A struct of numbers, one for each measure of a picture, null where it fails or the picture can't be read. All are
    taken in one pass by one Python process, which has a picture and what one measure makes of it at a time."""

    def number(a: np.ndarray | None, measure: Callable[[np.ndarray], float]) -> float | None:
        try:
            return None if a is None else float(measure(a.copy()))
        except FAILURES:
            return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[number(a, f) for f in measures.values()] for a in opened(batch)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)] or [pa.array([], pa.float64())] * len(measures), names=list(measures))

    return F.arrow_udf(run, ", ".join(f"`{k}` double" for k in measures))(picture)


def boundaries(picture: Column) -> Column:
    """Ruled lines of a column of pictures: rows and cols, or null if the picture can't be read. A lattice needs two of each."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                try:
                    rows, cols = ruled_boundaries(np.array(x["data"], np.float64).reshape(x["h"], x["w"], -1).squeeze())
                    out.append({"rows": rows, "cols": cols})
                except (TypeError, ValueError, IndexError):
                    out.append(None)
            yield pa.array(out, pa.struct([("rows", pa.list_(pa.int32())), ("cols", pa.list_(pa.int32()))]))

    return F.arrow_udf(run, "rows array<int>, cols array<int>")(picture)


def corners(picture: Column) -> Column:
    """Page corners of a column of pictures; null where none are found."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                try:
                    out.append(page_corners(np.array(x["data"], np.float64).reshape(x["h"], x["w"], -1).squeeze()))
                except (TypeError, ValueError, IndexError):
                    out.append(None)
            yield pa.array(out, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")(picture)
