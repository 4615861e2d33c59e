import struct
import zlib

import numpy as np
from dashgrid.functions import decoders as D
from dashgrid.functions import raster as G
from dashgrid.sources import files, images


def png(rgb):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_orientations():
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a)}
    for k, b in want.items():
        assert (G.upright(a, k) == b).all(), k


def test_sizes():
    assert G.fit_long_edge(np.zeros((3000, 4000), int), 1920).shape == (1440, 1920)
    assert G.fit_long_edge(np.zeros((10, 20), int), 1920).shape == (10, 20) and G.fit_long_edge(np.full((800, 900, 3), 7), 100).shape == (89, 100, 3)
    assert G.enlarged(np.zeros((100, 200), int)).shape == (200, 400) and G.enlarged(np.zeros((10, 3300), int)) is None and G.enlarged(np.zeros((100, 2000), int)).shape == (170, 3400)
    ramp = np.tile(np.arange(0, 200, 2), (4, 1))
    assert (G.subsample(ramp, 2)[0] == ramp[0, ::2] + 1).all() and abs(G.resize(ramp, 50, 4)[0, 25] - 101) <= 1


def photo(skew=0):
    g = np.full((300, 400), 30)
    for y in range(90, 210):
        x = 100 + int((y - 90) * skew)
        g[y, x:x + 180] = 200
    return g


def test_display_crops():
    crop, warped, skew = G.display_crop(photo())
    assert not warped and skew < 1 and np.abs(np.array(crop.shape) - (120 + 24, 180 + 36)).max() <= 2
    crop, warped, skew = G.display_crop(photo(0.3))
    assert warped and 10 < skew < 25 and (crop[10:-10, 20:-20] > 150).mean() > 0.95
    assert G.display_crop(np.full((100, 100), 9)) is None and G.display_crop(np.zeros((3, 3), int)) is None
    big, warped, _ = G.display_crop(np.kron(photo(), np.ones((4, 4), int)))
    assert not warped and abs(big.shape[1] - 864) < 20
    glare = photo()
    glare[100:130, 120:160] = 255
    clean, n, covered = G.without_glare(glare)
    assert n == 1 and 0 < covered < 0.02 and clean.max() == 200 and G.without_glare(photo())[1:] == (0, 0.0)
    assert G.quad_shape([(0, 0), (90, 0), (90, 40), (0, 40)]) == (0.0, False) and G.quad_shape([(45, 0), (90, 20), (45, 40), (0, 20)])[1]


def test_photos_to_variants(spark, tmp_path):
    rgb = np.stack([photo()] * 3, -1)
    rgb[..., 2] = 0                      # no blue
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.load_grids(spark, str(tmp_path), 200).collect()}
    a = np.array(got["a.png"].lum).reshape(got["a.png"].h, got["a.png"].w)
    assert a.shape == (150, 200) and a[75, 100] == (299 * 200 + 587 * 200) // 1000 and got["b.png"].lum is None
    d = images.load_grids(spark, str(tmp_path))
    crops = images.display_crops(d)
    c = crops.first()
    assert crops.count() == 1 and not c.warped and abs(c.w - 216) <= 2 and abs(c.h - 144) <= 2 and c.remarks[0].startswith("display warp: not applied, skew ~0.") and c.remarks[0].endswith("° (below 5° threshold)")
    v = {r.variant: (r.rung, r.w, r.h, len(r.lum)) for r in images.crop_variants(crops).collect()}
    assert v == {x: ("crop", 2 * c.w, 2 * c.h, 4 * c.w * c.h) for x in ("CLAHE_STRETCH", "MORPH_CLOSE_BIN", "ILLUM_FLAT_ADAPTIVE")}
    e = {r.path[-5:]: r.w for r in images.enlarge(d).collect()}
    assert e == {"a.png": 800, "b.png": None}
    listed = files.list_folder(spark, str(tmp_path), content=False)
    assert [r.name for r in images.take_images(listed, 1).collect()] == ["a.png"]
    assert images.display_crops(d.where("w < 0")).count() == 0


def test_two_stage_engine(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("1\n2\n3\n")
    chars = ["", *images.load_dictionary(spark, str(tmp_path / "dict.txt")).value, " "]
    g = np.full((100, 200), 10)
    g[20:40, 30:90], g[60:80, 100:180] = 200, 240
    sizes = []

    def read(part):
        sizes.append(part.shape)
        scores = np.zeros((4, len(chars)))
        scores[[0, 1, 2, 3], [1 if part.max() < 215 else 3, 0, 2, 2]] = 0.9
        return scores

    lines = images.two_stage_engine(lambda x: (x > 100) * 0.9, read, chars)(g)
    assert [x[0] for x in lines] == ["12", "32"] and lines[0][1] <= 30 and lines[0][3] >= 89 and all(s[0] == 48 for s in sizes)
    assert len(images.two_stage_engine(lambda x: (x > 100) * 0.9, read, chars, most=1)(g)) == 1 and images.two_stage_engine(lambda x: x * 0.0, read, chars)(g) == []
    assert D.ctc_text(np.zeros((0, 3)), chars) == ("", 0.0)
