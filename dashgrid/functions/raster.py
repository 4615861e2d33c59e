"""Luminance-grid kernels in numpy, and their use on columns of pixels.

Grids are 2-d integer arrays, 0 to 255. Kernels are pure functions; ``on_grids`` applies one to every row of
a frame in Arrow batches. A grid whose pixels don't fill width x height, or are null, gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Integer luminance of an (..., 3) RGB array."""
    c = rgb.astype(np.int64)
    return (299 * c[..., 0] + 587 * c[..., 1] + 114 * c[..., 2]) // 1000


def otsu(g: np.ndarray) -> int:
    """The first threshold of greatest between-class variance; foreground lies above it."""
    hist = np.bincount(np.clip(g, 0, 255).ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.where(ok, between, -1.0)))


def _window_sums(a: np.ndarray, r: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over windows clipped at the edges, and the windows' sizes."""
    n = a.shape[axis]
    sums = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
    i = np.arange(n)
    lo, hi = np.maximum(0, i - r), np.minimum(n - 1, i + r) + 1
    shape = [1] * a.ndim
    shape[axis] = n
    return np.take(sums, hi, axis) - np.take(sums, lo, axis), (hi - lo).reshape(shape)


def box_blur(g: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square, truncated after the rows and after the columns."""
    if r <= 0:
        return g.copy()
    for axis in (1, 0):
        s, n = _window_sums(g.astype(np.int64), r, axis)
        g = s // n
    return g


def gaussian5(g: np.ndarray) -> np.ndarray:
    """Binomial 1-4-6-4-1 over rows, then columns, edges repeated, truncated after each."""
    for axis in (1, 0):
        p = np.pad(g.astype(np.int64), [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = g.shape[axis]
        g = sum(w * np.take(p, np.arange(k, k + n), axis) for k, w in enumerate((1, 4, 6, 4, 1))) // 16
    return g


def morph_close(mask: np.ndarray, r: int) -> np.ndarray:
    """Dilation, then erosion, by a square clipped at the edges."""
    m = mask.astype(np.int64)
    for whole in (False, True):
        for axis in (1, 0):
            s, n = _window_sums(m, r, axis)
            m = (s == n if whole else s > 0).astype(np.int64)
    return m.astype(bool)


def label4(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components, numbered from 1 in raster order of their first pixel."""
    h, w = mask.shape
    flat = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(flat, axis=1)
    rows, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    parent = np.arange(len(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int64)
    numbers: dict[int, int] = {}
    for k in range(len(rows)):
        out[rows[k], starts[k]:ends[k]] = numbers.setdefault(root(k), len(numbers) + 1)
    return out, len(numbers)


def boxes(labels: np.ndarray, n: int) -> np.ndarray:
    """Per component: area, left, top, right, bottom (inclusive)."""
    y, x = np.nonzero(labels)
    c = labels[y, x] - 1
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = np.bincount(c, minlength=n)
    out[:, 1:3], out[:, 3:] = np.iinfo(np.int64).max, -1
    for k, v in ((1, x), (2, y)):
        np.minimum.at(out[:, k], c, v)
        np.maximum.at(out[:, k + 2], c, v)
    return out


def median_component_height(mask: np.ndarray) -> int | None:
    """Upper median of the components' heights."""
    labels, n = label4(mask)
    if not n:
        return None
    b = boxes(labels, n)
    return int(np.sort(b[:, 4] - b[:, 2] + 1)[n // 2])


def clahe(g: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation by tiles; what is clipped is spread evenly; maps are blended bilinearly."""
    h, w = g.shape
    if min(h, w) < 2 * tiles:
        return g.copy()
    th, tw = -(-h // tiles), -(-w // tiles)
    v = np.clip(g, 0, 255).astype(np.int64)
    maps = np.tile(np.arange(256), (tiles, tiles, 1))
    for ty in range(tiles):
        for tx in range(tiles):
            part = v[ty * th:(ty + 1) * th, tx * tw:(tx + 1) * tw]
            if part.size:
                hist = np.bincount(part.ravel(), minlength=256)
                clip = max(1, int(limit * part.size / 256))
                excess = int(np.maximum(0, hist - clip).sum())
                hist = np.minimum(hist, clip) + excess // 256 + (np.arange(256) < excess % 256)
                maps[ty, tx] = np.cumsum(hist) * 255 // max(1, hist.sum())
    gy = np.clip((np.arange(h) - th / 2) / th, 0, tiles - 1)[:, None]
    gx = np.clip((np.arange(w) - tw / 2) / tw, 0, tiles - 1)[None, :]
    y0, x0 = gy.astype(int), gx.astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1), gy - y0, gx - x0
    top = maps[y0, x0, v] * (1 - fx) + maps[y0, x1, v] * fx
    low = maps[y1, x0, v] * (1 - fx) + maps[y1, x1, v] * fx
    return np.clip((top * (1 - fy) + low * fy).astype(np.int64), 0, 255)


def flatten_illumination(g: np.ndarray, r: int | None = None) -> np.ndarray:
    """Divides by a twice-blurred background, then stretches to the full range."""
    r = max(4, g.shape[1] // 8) if r is None else r
    back = box_blur(box_blur(g, r), r)
    f = np.minimum(255, g.astype(np.int64) * 128 // np.maximum(1, back))
    lo, hi = int(f.min()), int(f.max())
    return f if hi <= lo else (f - lo) * 255 // (hi - lo)


def adaptive_threshold(g: np.ndarray, block: int, c: int) -> np.ndarray:
    return g > box_blur(g, block // 2) + c


def sharpness(g: np.ndarray) -> float:
    """Population variance of the Laplacian over inner pixels, 0 for grids under 3 pixels wide or high."""
    if min(g.shape) < 3:
        return 0.0
    g = g.astype(np.int64)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    n, total, squares = lap.size, int(lap.sum()), int((lap * lap).sum())  # whole numbers, so that no order of summing matters
    return (n * squares - total * total) / float(n * n)


def minority(mask: np.ndarray) -> np.ndarray:
    """The mask or its inverse, whichever is the smaller part."""
    return ~mask if mask.sum() * 2 > mask.size else mask


def upscale2(g: np.ndarray) -> np.ndarray:
    """Twice the size, bilinear between pixel centres."""
    def axis(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1)
        lo = at.astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(g.shape[0]), axis(g.shape[1])
    rows = g[y0] * (1 - fy)[:, None] + g[y1] * fy[:, None]
    return np.rint(rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(np.int64)


def preprocess(g: np.ndarray, variant: str) -> np.ndarray:
    """One of the preparation variants ahead of recognition."""
    if variant == "CLAHE_STRETCH":
        return upscale2(clahe(g))
    if variant == "MORPH_CLOSE_BIN":
        s = gaussian5(g)
        ink = minority(s > otsu(s))
        tall = median_component_height(ink)
        kernel = 7 if tall is None else max(3, int(0.12 * tall))
        return upscale2(np.where(morph_close(ink, kernel // 2), 0, 255))
    if variant == "ILLUM_FLAT_ADAPTIVE":
        ink = minority(adaptive_threshold(flatten_illumination(g), max(15, (g.shape[0] // 10) | 1), 5))
        return upscale2(np.where(ink, 0, 255))
    return g


def inpaint_glare(g: np.ndarray, threshold: int = 250, least: float = 0.005) -> tuple[np.ndarray, int, float] | None:
    """Large glare regions filled with the upper median around them: (grid, regions, share covered), or None."""
    glare = g > threshold
    labels, n = label4(glare)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    big = np.flatnonzero(sizes > least * g.size) + 1
    if not len(big):
        return None
    out = g.copy()
    for c in big:
        region = labels == c
        ring = np.zeros_like(region)
        padded = np.pad(region, 2)
        for dy in range(5):
            for dx in range(5):
                ring |= padded[dy:dy + g.shape[0], dx:dx + g.shape[1]]
        around = np.sort(g[ring & ~glare])
        out[region] = around[len(around) // 2] if len(around) else 128
    return out, len(big), float(sizes[big - 1].sum() / g.size)


def extreme_corners(mask: np.ndarray) -> list[tuple[float, float]]:
    """Corners (top left, top right, bottom right, bottom left) by extreme x+y and x-y of a component."""
    y, x = np.nonzero(mask)
    return [(float(x[i]), float(y[i])) for i in (np.argmin(x + y), np.argmax(x - y), np.argmax(x + y), np.argmin(x - y))]


def bright_display(g: np.ndarray) -> tuple[list[int], list[tuple[float, float]]] | None:
    """Box (left, top, right, bottom) and corners of the largest bright region shaped like a display."""
    h, w = g.shape
    if min(h, w) < 16:
        return None
    bright = g > otsu(g)
    lit = int(bright.sum())
    if not lit or lit > g.size * 8 // 10:
        return None
    labels, n = label4(bright)
    b = boxes(labels, n)
    bw, bh = b[:, 3] - b[:, 1] + 1, b[:, 4] - b[:, 2] + 1
    good = (b[:, 0] >= 0.02 * g.size) & (bw / bh >= 0.8) & (bw / bh <= 4.5) & (b[:, 0] / (bw * bh) >= 0.45)
    if not good.any():
        return None
    k = int(np.argmax(np.where(good, b[:, 0], -1)))
    return b[k, 1:].tolist(), extreme_corners(labels == k + 1)


def warp(g: np.ndarray, corners: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrilateral stretched to a rectangle, bilinear."""
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    rows, rhs = [], []
    for (u, v), (x, y) in zip(to, corners):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        rhs += [x, y]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)
    v, u = np.mgrid[:height, :width]
    x, y, z = (m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)]))
    x, y = np.clip(x / z, 0, g.shape[1] - 1), np.clip(y / z, 0, g.shape[0] - 1)
    x0, y0 = x.astype(int), y.astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, g.shape[1] - 1), np.minimum(y0 + 1, g.shape[0] - 1), x - x0, y - y0
    top, low = g[y0, x0] * (1 - fx) + g[y0, x1] * fx, g[y1, x0] * (1 - fx) + g[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.int64).reshape(height, width)


def subsample(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n x n blocks; what doesn't fill a block at the right and bottom goes."""
    h, w = a.shape[0] // n, a.shape[1] // n
    return a if n == 1 else a[:h * n, :w * n].reshape(h, n, w, n, *a.shape[2:]).mean((1, 3)).astype(a.dtype)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear between pixel centres, for grids and (..., 3) images."""
    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        lo = at.astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (y0, y1, fy), (x0, x1, fx) = axis(a.shape[0], height), axis(a.shape[1], width)
    fy, fx = fy.reshape(-1, *[1] * (a.ndim - 1)), fx.reshape(1, -1, *[1] * (a.ndim - 2))
    rows = a[y0] * (1 - fy) + a[y1] * fy
    return np.rint(rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(a.dtype)


def fit_long_edge(a: np.ndarray, longest: int) -> np.ndarray:
    """Halved while at least twice too long, then scaled so that the longer edge is at most ``longest``."""
    n, edge = 1, max(a.shape[:2])
    while edge // (n * 2) >= longest:
        n *= 2
    a = subsample(a, n)
    edge = max(a.shape[:2])
    return a if edge <= longest else resize(a, max(1, int(a.shape[1] * longest / edge)), max(1, int(a.shape[0] * longest / edge)))


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned and mirrored as its orientation tag (1 to 8) says."""
    if orientation in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return np.ascontiguousarray(a)


def enlarged(g: np.ndarray, longest: int = 3400) -> np.ndarray | None:
    """Twice the size, or as much of it as the longer edge allows; None if that is hardly more (1.1 times)."""
    k = min(2.0, longest / max(g.shape[:2])) if g.size else 0.0
    return None if k <= 1.1 else resize(g, int(g.shape[1] * k), int(g.shape[0] * k))


def quad_shape(c: list[tuple[float, float]]) -> tuple[float, bool]:
    """Greatest skew of an edge in degrees, and whether the corners (from the top left, clockwise) make no usable display."""
    p = np.array(c)
    edges = np.abs(np.roll(p, -1, 0) - p)
    flat = np.degrees(np.arctan2([edges[0, 1], edges[2, 1], edges[1, 0], edges[3, 0]], [edges[0, 0], edges[2, 0], edges[1, 1], edges[3, 1]]))
    q, sides = np.roll(p, -1, 0), np.hypot(*edges.T)
    area, box = abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2, float(np.prod(np.ptp(p, axis=0)))
    return float(flat.max()), bool(box <= 0 or sides[[0, 2]].mean() < 2 or sides[[1, 3]].mean() < 2 or area < 0.6 * box)


#: Longest edge at which a display is looked for; skew from which it is warped; least edge and greatest share of a crop.
ANALYSIS_EDGE, WARP_DEGREES, LEAST_CROP, MOST_CROP = 384, 5.0, 64, 0.85


def display_crop(g: np.ndarray, longest: int = 3400) -> tuple[np.ndarray, bool, float] | None:
    """The lit display of a photo: (grid, warped, skew); rectified if clearly skewed, else its box with a margin of a tenth."""
    h, w = g.shape
    k = ANALYSIS_EDGE / max(h, w, 1)
    small = resize(g, max(16, int(w * k)), max(16, int(h * k))) if k < 1 else g
    found = bright_display(small)
    if found is None:
        return None
    (x0, y0, x1, y1), corners = found
    fx, fy = w / small.shape[1], h / small.shape[0]
    skew, bad = quad_shape(corners)
    if not bad and skew > WARP_DEGREES:
        full = np.array(corners) * [fx, fy]
        top, right, bottom, left = np.hypot(*(np.roll(full, -1, 0) - full).T)
        size = [int(np.clip(np.floor(x + 0.5), LEAST_CROP, longest)) for x in ((top + bottom) / 2, (left + right) / 2)]
        try:
            return warp(g, [tuple(c) for c in full], *size), True, skew
        except np.linalg.LinAlgError:
            pass
    mx, my = int((x1 - x0 + 1) * fx * 0.10), int((y1 - y0 + 1) * fy * 0.10)
    left, top, right, bottom = max(0, int(x0 * fx) - mx), max(0, int(y0 * fy) - my), min(w - 1, int(x1 * fx) + mx), min(h - 1, int(y1 * fy) + my)
    cw, ch = right - left + 1, bottom - top + 1
    if min(cw, ch) < LEAST_CROP or cw * ch > MOST_CROP * w * h:
        return None
    return g[top:bottom + 1, left:right + 1], False, skew


def without_glare(g: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The grid with large glare filled in, the number of regions and the share covered; unchanged (0, 0.0) if there is none."""
    r = inpaint_glare(g)
    return (g, 0, 0.0) if r is None else (np.clip(r[0], 0, 255), r[1], r[2])


def round_to_32(n: int) -> int:
    return max(32, int(np.floor(n / 32 + 0.5)) * 32)


def normalise(rgb: np.ndarray, symmetric: bool) -> np.ndarray:
    """Channel-first floats: (x/255 - .5)/.5, or by the usual mean and deviation of natural images."""
    x = rgb.astype(np.float32) / 255
    mean, dev = ((0.5,) * 3, (0.5,) * 3) if symmetric else ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return ((x - np.float32(mean)) / np.float32(dev)).transpose(2, 0, 1)


def on_grids(df: DataFrame, pixels: str, width: str, height: str, keep: list[str], out: T.StructType, kernel: Callable[[np.ndarray], tuple | None]) -> DataFrame:
    """``keep`` columns plus the kernel's results (``out``) for every grid; null where the kernel gives None."""
    slim = df.select(*keep, pixels, width, height)
    schema = T.StructType([*(slim.schema[c] for c in keep), *out.fields])
    names = [f.name for f in out.fields]
    arrow = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, w, h in zip(b.column(pixels), b.column(width).to_pylist(), b.column(height).to_pylist()):
                ok = p.is_valid and w and h and len(p) >= w * h
                r = kernel(p.values.to_numpy(zero_copy_only=False)[:w * h].reshape(h, w)) if ok else None
                got.append(r if r is not None else (None,) * len(arrow))
            cols = [pa.array([r[i] for r in got], type=t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *names])

    return slim.mapInArrow(run, schema)
