"""Decoders: text from class scores, boxes from probability maps, digits from seven-segment displays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import raster as G

#: Limits of the segment reader (lower cells are dots, narrower ones the digit 1 if filled enough; confidences
#: of a digit one segment off and of a reading cut short; most column runs and most cells).
DOT_HEIGHT, ONE_WIDTH, ONE_FILL, NEAR_MISS, CUT_SHORT, MOST_RUNS, MOST_CELLS = 0.4, 0.4, 0.3, 0.8, 0.85, 16, 8

#: Segments a to g (bits 0 to 6) of the digits, and their zones as shares of a cell (x0, y0, x1, y1).
DIGITS = ("abcdef", "bc", "abged", "abgcd", "fgbc", "afgcd", "afgedc", "abc", "abcdefg", "abcdfg")
ZONES = {"a": (0.20, 0.00, 0.80, 0.20), "f": (0.00, 0.05, 0.25, 0.45), "b": (0.75, 0.05, 1.00, 0.45), "g": (0.20, 0.40, 0.80, 0.60),
         "e": (0.00, 0.55, 0.25, 0.95), "c": (0.75, 0.55, 1.00, 0.95), "d": (0.20, 0.80, 0.80, 1.00)}


def charset(dictionary: Column) -> Column:
    """Blank first, the dictionary, a space last."""
    return F.concat(F.array(F.lit("")), dictionary, F.array(F.lit(" ")))


def ctc_greedy(logits: Column, steps: Column, classes: Column, chars: Column) -> Column:
    """struct<text,confidence>: best class of each step, repeats collapsed, blanks dropped; the mean of what is kept.

    Sizes that don't fit give an empty text of confidence 0; a class without a character adds none.
    """
    ok = (steps > 0) & (classes > 0) & (F.size(logits) >= steps * classes)
    row = lambda t: F.slice(logits, (t * classes + 1).cast("int"), classes.cast("int"))
    best = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), lambda t: F.struct(
        (F.array_position(row(t), F.array_max(row(t))) - 1).cast("int").alias("k"), F.array_max(row(t)).cast("double").alias("p")))
    kept = F.filter(F.transform(best, lambda x, i: F.struct(x["k"].alias("k"), x["p"].alias("p"), F.coalesce(F.get(best, i - 1)["k"], F.lit(-1)).alias("was"))),
                    lambda x: (x["k"] != 0) & (x["k"] != x["was"]))
    text = F.array_join(F.transform(kept, lambda x: F.coalesce(F.get(chars, x["k"]), F.lit(""))), "")
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["p"]) / F.nullif(F.size(kept), F.lit(0))
    return F.struct(F.when(ok, text).otherwise("").alias("text"), F.when(ok, F.coalesce(mean, F.lit(0.0))).otherwise(0.0).alias("confidence"))


def ctc_text(scores: np.ndarray, chars: list[str]) -> tuple[str, float]:
    """``ctc_greedy`` for one (steps, classes) array."""
    if scores.ndim != 2 or not scores.size:
        return "", 0.0
    best = scores.argmax(1)
    kept = (best != 0) & (best != np.r_[-1, best[:-1]])
    text = "".join(chars[k] if k < len(chars) else "" for k in best[kept])
    return text, float(scores.max(1)[kept].mean()) if kept.any() else 0.0


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corner points in order, collinear ones left out."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def min_area_rect(hull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """Centre, unit axis and half extents of the smallest rectangle along a hull edge."""
    edge = np.roll(hull, -1, 0) - hull
    length = np.hypot(edge[:, 0], edge[:, 1])
    u = edge[length > 1e-9] / length[length > 1e-9, None]
    if len(hull) < 3 or not len(u):
        return None
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = hull @ u.T, hull @ v.T
    spans = a.max(0) - a.min(0), b.max(0) - b.min(0)
    k = int(np.argmin(spans[0] * spans[1]))
    centre = u[k] * (a[:, k].max() + a[:, k].min()) / 2 + v[k] * (b[:, k].max() + b[:, k].min()) / 2
    return centre, u[k], spans[0][k] / 2, spans[1][k] / 2


def order_corners(p: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    s, d = p.sum(1), p[:, 0] - p[:, 1]
    first, last = np.argsort(s, kind="stable")[[0, -1]]
    rest = [i for i in np.argsort(d, kind="stable") if i not in (first, last)]
    return p[[first, rest[-1], last, rest[0]]]


def _corners(c: np.ndarray, u: np.ndarray, hw: float, hh: float) -> np.ndarray:
    v = np.array([-u[1], u[0]])
    return np.array([c - u * hw - v * hh, c + u * hw - v * hh, c + u * hw + v * hh, c - u * hw + v * hh])


def _mean_inside(prob: np.ndarray, poly: np.ndarray) -> float:
    """Mean over the pixels inside a polygon, by the even-odd rule."""
    h, w = prob.shape
    x0, y0 = np.maximum(0, np.floor(poly.min(0))).astype(int)
    x1, y1 = np.minimum([w - 1, h - 1], np.ceil(poly.max(0))).astype(int)
    if x1 < x0 or y1 < y0:
        return 0.0
    y, x = np.mgrid[y0:y1 + 1, x0:x1 + 1].astype(float)
    inside = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(poly, np.roll(poly, 1, 0)):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return float(prob[y0:y1 + 1, x0:x1 + 1][inside].mean()) if inside.any() else 0.0


def text_boxes(prob: np.ndarray, sx: float = 1.0, sy: float = 1.0, threshold: float = 0.3, least: float = 0.6, ratio: float = 1.5,
               side: float = 3.0, most: int = 200) -> list[tuple[list[tuple[float, float]], float]]:
    """(corners, score) of text regions in raster order: rectangles grown by area * ratio / perimeter."""
    labels, n = G.label4(prob > threshold)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(labels == k)
        if len(x) < 4 or len(hull := convex_hull(np.stack([x, y], 1).astype(float))) < 3 or (r := min_area_rect(hull)) is None:
            continue
        c, u, hw, hh = r
        if 2 * min(hw, hh) < side or (score := _mean_inside(prob, _corners(c, u, hw, hh))) < least:
            continue
        grow = 4 * hw * hh * ratio / (4 * (hw + hh))
        corners = order_corners(_corners(c, u, hw + grow, hh + grow)) * [sx, sy]
        out.append(([(float(a), float(b)) for a, b in corners], score))
        if len(out) == most:
            break
    return out


def _runs(filled: np.ndarray, least: int) -> list[tuple[int, int]]:
    d = np.diff(np.r_[0, filled.astype(np.int8), 0])
    return [(a, b) for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)) if b - a >= least]


def _cells(fg: np.ndarray) -> list[tuple[int, int, int, int]] | None:
    """Glyph boxes (x0, x1, y0, y1; ends excluded) from column runs; narrow gaps are closed."""
    h, _ = fg.shape
    runs = _runs(fg.sum(0) > max(1, h // 25), 2)
    if not runs or len(runs) > MOST_RUNS:
        return None
    gap = max(1, int(0.30 * sorted(b - a for a, b in runs)[len(runs) // 2]))
    joined = [runs[0]]
    for a, b in runs[1:]:
        joined[-1:] = [(joined[-1][0], b)] if a - joined[-1][1] <= gap else [joined[-1], (a, b)]
    if len(joined) > MOST_CELLS:
        return None
    cells = []
    for a, b in joined:
        rows = np.flatnonzero(fg[:, a:b].sum(1) > max(1, (b - a) // 10))
        if not len(rows):
            return None
        cells.append((a, b, int(rows[0]), int(rows[-1]) + 1))
    return cells


def _segments(g: np.ndarray) -> int:
    """Lit segments of one cell as bits: zone means against the midpoint of its dark and bright modes."""
    h, w = g.shape
    hist, split = np.bincount(g.ravel(), minlength=256), G.otsu(g)
    dark, bright = int(np.argmax(hist[:split + 1])), hist[split + 1:]
    threshold = (dark + split + 1 + int(np.argmax(bright))) // 2 if bright.size and bright.max() > 0 else split
    half, mask = max(1, min(w, h) // 16), 0
    for s, (x0, y0, x1, y1) in ZONES.items():
        cx, cy = int((x0 + x1) / 2 * w), int((y0 + y1) / 2 * h)
        zone = g[max(0, cy - half):cy + half + 1, max(0, cx - half):cx + half + 1]
        if zone.size and int(zone.sum()) // zone.size > threshold:
            mask |= 1 << (ord(s) - ord("a"))
    return mask


_MASKS = [sum(1 << (ord(s) - ord("a")) for s in d) for d in DIGITS]


def read_segments(g: np.ndarray) -> tuple[str, float] | None:
    """Digits of a seven-segment display and a confidence, or None if they don't decode cleanly."""
    h, w = g.shape
    if min(h, w) < 8:
        return None
    lit = g > G.otsu(g)
    if not 0 < lit.sum() < g.size:
        return None
    ink = 255 - g if lit.sum() > g.size // 2 else g
    e = G.flatten_illumination(G.clahe(ink), max(w, h) // 2)
    fg = G.adaptive_threshold(e, max(15, h // 2), 5) & (e > G.otsu(e))
    if not fg.any() or (cells := _cells(fg)) is None:
        return None
    tallest, middle = max(c[3] - c[2] for c in cells), (min(c[2] for c in cells) + max(c[3] - 1 for c in cells)) // 2
    out, digits, confidence = "", 0, 1.0
    for x0, x1, y0, y1 in cells:
        ch, cw, found, cost = y1 - y0, x1 - x0, None, 0
        if ch < DOT_HEIGHT * tallest:
            if y0 >= middle and out:
                out += "."
                continue
        elif cw < ONE_WIDTH * ch:
            if fg[y0:y1, x0:x1].mean() >= ONE_FILL:
                found = "1"
        else:
            m = _segments(e[y0:y1, x0:x1])
            costs = [(p & ~m).bit_count() + 2 * (m & ~p).bit_count() for p in _MASKS]
            cost = min(costs)
            found = str(costs.index(cost)) if cost < 2 else None
        if found is None:  # a unit behind the digits ends them, anything else spoils the reading
            if digits < 2:
                return None
            confidence = min(confidence, CUT_SHORT)
            break
        out, digits = out + found, digits + 1
        confidence = min(confidence, NEAR_MISS) if cost else confidence
    if not digits:
        return None
    head, dot, last = out.rpartition(".")
    return (head.replace(".", "") + ("" if len(last) == 3 else dot) + last if dot else out), confidence
