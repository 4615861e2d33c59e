import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dashgrid.functions import decoders as D
from dashgrid.functions import raster as G


def brute_blur(g, r):
    for axis in (1, 0):
        out = g.copy()
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                part = g[y, max(0, x - r):x + r + 1] if axis else g[max(0, y - r):y + r + 1, x]
                out[y, x] = part.sum() // len(part)
        g = out
    return g


def test_blur_against_brute_force():
    g = np.random.default_rng(1).integers(0, 256, (9, 13))
    for r in (0, 1, 3, 20):
        assert (G.box_blur(g, r) == brute_blur(g, r)).all()


def test_otsu_and_labels():
    g = np.full((20, 20), 30)
    g[5:10, 5:10] = 200
    g[10:12, 10:12] = 200
    assert 30 <= G.otsu(g) < 200 and G.otsu(np.zeros((4, 4), int)) == 0
    labels, n = G.label4(g > 100)
    assert n == 2 and labels[5, 5] == 1 and labels[11, 11] == 2
    assert G.boxes(labels, n).tolist() == [[25, 5, 5, 9, 9], [4, 10, 10, 11, 11]]
    assert G.median_component_height(np.zeros((3, 3), bool)) is None and G.median_component_height(g > 100) == 5


def test_labels_against_flood_fill():
    mask = np.random.default_rng(2).random((40, 50)) < 0.6
    labels, n = G.label4(mask)
    seen, count = np.zeros(mask.shape, bool), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 50 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    assert labels[a, b] == count
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == count


def test_filters():
    g = np.where(np.indices((160, 160)).sum(0) // 10 % 2, 115, 100)
    assert np.ptp(G.clahe(g, limit=100.0)) > 3 * np.ptp(g)
    flat = np.full((96, 96), 25)
    flat[30:60, 30:60] = 225
    assert G.clahe(flat)[0, 0] < 100  # an even background keeps its mass and stays dark
    assert (G.clahe(g[:15]) == g[:15]).all()
    m = np.zeros((9, 20), bool)
    m[4, 2:8] = m[4, 10:16] = True
    assert G.morph_close(m, 2)[4, 8:10].all()
    assert G.sharpness(np.full((10, 10), 7)) == 0 and G.sharpness(np.indices((20, 20)).sum(0) % 2 * 255) > 600
    assert G.round_to_32(1) == 32 and G.round_to_32(100) == 96


def test_glare_and_display():
    g = np.full((100, 100), 40)
    assert G.inpaint_glare(g) is None
    g[10:30, 10:30] = 255
    out, regions, covered = G.inpaint_glare(g)
    assert regions == 1 and out[20, 20] == 40 and 0.03 < covered < 0.05
    h = np.full((200, 200), 20)
    h[60:110, 40:140] = 220
    box, corners = G.bright_display(h)
    assert box == [40, 60, 139, 109] and corners[0] == (40, 60) and corners[2] == (139, 109)
    assert G.bright_display(np.full((64, 64), 9)) is None


def test_warp_of_a_rectangle():
    g = np.arange(100).reshape(10, 10)
    assert (G.warp(g, [(2, 1), (7, 1), (7, 8), (2, 8)], 6, 8) == g[1:9, 2:8]).all()


def render(text, invert=False, broken=()):
    """Seven-segment digits, 60 x 100, stroke 12; a dot is a 12 x 12 blob."""
    s, m = 12, 20
    zones = {"a": (0, 0, 60, s), "g": (0, 44, 60, 56), "d": (0, 88, 60, 100), "f": (0, 0, s, 50), "b": (48, 0, 60, 50), "e": (0, 50, s, 100), "c": (48, 50, 60, 100)}
    g = np.full((140, m + sum(s + 20 if c == "." else 80 for c in text) + m), 20)
    x = m
    for k, c in enumerate(text):
        if c == ".":
            g[m + 88:m + 100, x:x + s] = 230
            x += s + 20
            continue
        for seg in D.DIGITS[int(c)]:
            if (k, seg) not in broken:
                x0, y0, x1, y1 = zones[seg]
                g[m + y0:m + y1, x + x0:x + x1] = 230
        x += 80
    return 255 - g if invert else g


@pytest.mark.parametrize("text,want", [("12941", "12941"), ("01234", "01234"), ("56789", "56789"), ("0.0", "0.0"), ("12.676", "12676")])
def test_segments(text, want):
    got, confidence = D.read_segments(render(text))
    assert got == want and confidence >= 0.9


def test_segments_inverted_broken_blank():
    assert D.read_segments(render("42", invert=True))[0] == "42"
    got, confidence = D.read_segments(render("18", broken={(1, "c")}))
    assert got == "18" and 0.7 <= confidence <= 0.95
    assert D.read_segments(np.full((80, 80), 30)) is None and D.read_segments(np.zeros((4, 4), int)) is None


def test_boxes():
    p = np.zeros((60, 100))
    p[20:30, 10:50] = 0.95
    p[40:48, 60:90] = 0.45
    (corners, score), = D.text_boxes(p)
    assert score > 0.9 and corners[0][0] < 10 and corners[0][1] < 20 and corners[2][0] > 49
    assert D.text_boxes(np.zeros((10, 10))) == []
    hull = D.convex_hull(np.array([(x, y) for x in range(11) for y in range(11)], float))
    assert len(hull) == 4
    c = D.order_corners(np.array([(62, 52), (8, 10), (10, 50), (60, 12)], float))
    assert c.tolist() == [[8, 10], [60, 12], [62, 52], [10, 50]]


def test_ctc(spark):
    def run(classes, n=5):
        flat = [0.9 if k == c else 0.01 for c in classes for k in range(n)]
        d = spark.createDataFrame([(flat,)], "l array<double>")
        r = d.select(D.ctc_greedy(F.col("l"), F.lit(len(classes)), F.lit(n), D.charset(F.array(F.lit("0"), F.lit("1"), F.lit("2")))).alias("o")).first().o
        return r.text, round(r.confidence, 6)

    assert run([2, 2, 0, 2, 3]) == ("112", 0.9) and run([0, 0]) == ("", 0.0)
    d = spark.createDataFrame([([0.1],)], "l array<double>")
    r = d.select(D.ctc_greedy(F.col("l"), F.lit(4), F.lit(4), D.charset(F.array(F.lit("x")))).alias("o")).first().o
    assert (r.text, r.confidence) == ("", 0.0)


def test_grids_in_a_frame(spark):
    d = spark.createDataFrame([(1, [0, 0, 9, 9], 2, 2), (2, None, 2, 2), (3, [1], 2, 2), (4, [], 0, 0)], "id int, lum array<int>, w int, h int")
    out = G.on_grids(d, "lum", "w", "h", ["id"], StructType([StructField("t", IntegerType())]), lambda g: (G.otsu(g),))
    assert {r.id: r.t for r in out.collect()} == {1: 0, 2: None, 3: None, 4: None}


def test_grid_queries_give_whole_grids_and_all_boxes(spark):
    import json

    from dashgrid.functions import raster
    from dashgrid.plans.recognition import QUERIES

    d = "/root/testdata/sf0.001"
    assert all(len(r.equalised.split(",")) == 32 * 32 for r in QUERIES["clahe"](spark, d).limit(5).collect())
    assert all(len(r.filled.split(",")) == 32 * 32 for r in QUERIES["glare_inpaint"](spark, d).where("filled is not null").limit(5).collect())
    size = raster.preprocess(np.zeros((32, 32), dtype=np.int64), "CLAHE_STRETCH").size
    assert all(len(x.split(",")) == size for r in QUERIES["preprocess_variants"](spark, d).limit(3).collect() for x in (r.clahe, r.closed, r.adaptive))
    for r in QUERIES["db_boxes"](spark, d).limit(20).collect():
        found = json.loads(r.found)
        assert len(found) == r.boxes and max((s for _, s in found), default=None) == r.best
