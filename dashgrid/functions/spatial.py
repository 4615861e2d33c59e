"""Positions of recognised lines: predicates and distances over ``struct<text,left,top,right,bottom,...>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "struct<i:int,text:string,left:int,top:int,right:int,bottom:int,confidence:float>"


def _half(a: Column, b: Column) -> Column:
    s = a + b  # truncating, also below zero
    return F.when(s < 0, -F.floor(-s / 2)).otherwise(F.floor(s / 2)).cast("int")


def centre_x(b: Column) -> Column:
    return _half(b["left"], b["right"])


def centre_y(b: Column) -> Column:
    return _half(b["top"], b["bottom"])


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def distance(a: Column, b: Column) -> Column:
    dx, dy = (centre_x(a) - centre_x(b)).cast("double"), (centre_y(a) - centre_y(b)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def below_or_beside(anchor: Column, line: Column) -> Column:
    """Near enough under the anchor, or on its row and not far off; much taller lines are refused."""
    h = F.greatest(height(anchor), F.lit(1))
    overlap = (line["left"] < anchor["right"]) & (line["right"] > anchor["left"])
    gap = F.greatest(line["left"] - anchor["right"], anchor["left"] - line["right"])
    below = (centre_y(line) > centre_y(anchor)) & (line["top"] - anchor["bottom"] <= 1.5 * h) & (overlap | (gap <= 2 * h))
    beside = (line["top"] < anchor["bottom"]) & (line["bottom"] > anchor["top"]) & (gap <= 3 * h)
    return (height(line) <= 5 * h) & (below | beside)


def directly_below(label: Column, line: Column) -> Column:
    return (centre_y(line) > centre_y(label)) & (line["top"] - label["bottom"] <= 1.5 * height(label))


def relation(anchor: Column, line: Column) -> Column:
    return F.when(centre_y(line) > anchor["bottom"], "nearest-below").otherwise("nearest-beside")


def box_text(b: Column) -> Column:
    return F.format_string("[L:%d T:%d R:%d B:%d]", b["left"], b["top"], b["right"], b["bottom"])


def region_below(a: Column, width: Column, height_: Column) -> Column:
    """Where a value is expected under an anchor, clamped to the image; null if nothing (or under 8 pixels) is left."""
    w, h = (a["right"] - a["left"]).cast("double"), height(a).cast("double")
    left, top = F.greatest(F.lit(0), a["left"] - F.floor(0.3 * w)), F.greatest(F.lit(0), a["bottom"])
    right, bottom = F.least(width, a["right"] + F.floor(0.6 * w)), F.least(height_, a["bottom"] + F.floor(2.4 * h))
    box = F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))
    return F.when((w > 0) & (h > 0) & (right - left >= 8) & (bottom - top >= 8), box)


def padded_box(b: Column, width: Column, height_: Column) -> Column:
    """A line's box with a margin of 6 % of its width and 12 % of its height, clamped to the image."""
    px, py = F.floor(0.06 * (b["right"] - b["left"])), F.floor(0.12 * height(b))
    return F.struct(F.greatest(F.lit(0), b["left"] - px).cast("int").alias("left"), F.greatest(F.lit(0), b["top"] - py).cast("int").alias("top"),
                    F.least(width, b["right"] + px).cast("int").alias("right"), F.least(height_, b["bottom"] + py).cast("int").alias("bottom"))


def quad_metrics(p: Column) -> Column:
    """Shoelace area, bounding area, mean sides, skew and degeneracy of four corners (clockwise from top left)."""
    a, b, c, d = (F.get(p, F.lit(i)) for i in range(4))
    cross = lambda u, v: u["x"] * v["y"] - v["x"] * u["y"]
    side = lambda u, v: F.sqrt((u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"]))
    area = F.abs(cross(a, b) + cross(b, c) + cross(c, d) + cross(d, a)) / 2
    xs, ys = [q["x"] for q in (a, b, c, d)], [q["y"] for q in (a, b, c, d)]
    box = (F.greatest(*xs) - F.least(*xs)) * (F.greatest(*ys) - F.least(*ys))
    width, tall = (side(a, b) + side(d, c)) / 2, (side(b, c) + side(a, d)) / 2
    flat = lambda u, v: F.abs(F.degrees(F.atan2(v["y"] - u["y"], v["x"] - u["x"])))
    steep = lambda u, v: F.abs(F.degrees(F.atan2(v["x"] - u["x"], v["y"] - u["y"])))
    skew = F.greatest(flat(a, b), flat(d, c), steep(a, d), steep(b, c))
    bad = (box <= 0) | (width < 2) | (tall < 2) | (area < 0.6 * box)
    return F.struct(area.alias("area"), box.alias("box_area"), width.alias("width"), tall.alias("height"), skew.alias("skew"), bad.alias("degenerate"))
