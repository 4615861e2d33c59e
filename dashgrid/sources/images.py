"""Photos as luminance grids, the variants of them that retries look at, and recognisers made of two models.

Spark's image source decodes on the executors (its bytes come as BGR); orientation is read from the files' own
bytes. All pixel work is done in Arrow batches, one photo at a time, so a batch's memory is that of its photos.

Defined results: a file that can't be decoded keeps its row with a null grid; a photo without a lit display
has no crop; null grids give null, or no row where rows are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import raster as G
from ..functions.decoders import ctc_text, text_boxes
from ..operators.ladder import CROP_VARIANTS
from ..schemas import MOST_BOXES, MOST_IMAGES
from .files import exif_orientation, read_dictionary

#: Longest edges of the first decoding and of the retry; remarks on crop and glare; sizes of the reader's input.
FIRST_EDGE, RETRY_EDGE = 1920, 3400
WARPED = "display warp: applied, skew ~%.1f°"
NOT_WARPED = "display warp: not applied, skew ~%.1f° (below %.0f° threshold)"
GLARE = "glare mask: inpainted %d region(s), %.1f%% of crop"
READER_HEIGHT, READER_WIDTHS = 48, (16, 1600)

_GRID = [T.StructField("lum", T.ArrayType(T.IntegerType())), T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]


def take_images(files: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """The first images by path, as many as are taken at once."""
    return files.orderBy("path").limit(most)


def _place(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "file:/")


def load_grids(spark: SparkSession, folder: str, longest: int = FIRST_EDGE) -> DataFrame:
    """(path, lum, w, h) of every image file of a folder: decoded, scaled to the longest edge, turned upright."""
    pattern = folder.rstrip("/") + "/*"
    files = spark.read.format("binaryFile").load(pattern).select(_place(F.col("path")).alias("path"), "content")
    pixels = spark.read.format("image").option("dropInvalid", "true").load(pattern).select(
        _place(F.col("image.origin")).alias("path"), F.col("image.height").alias("ih"), F.col("image.width").alias("iw"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    schema = T.StructType([T.StructField("path", T.StringType()), *_GRID])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():  # a photo at a time
                grid = None
                if r["data"] is not None and r["iw"] and r["ih"]:
                    a = np.frombuffer(r["data"], np.uint8).reshape(r["ih"], r["iw"], r["n"])
                    rgb = a[..., 2::-1] if r["n"] >= 3 else np.repeat(a[..., :1], 3, 2)
                    grid = G.luminance(G.upright(G.fit_long_edge(rgb.astype(np.int64), longest), exif_orientation(r["content"])))
                yield _grid_row(r["path"], grid)

    def _grid_row(path: str, g: np.ndarray | None) -> pa.RecordBatch:
        cols = [pa.array([path]), pa.array([None if g is None else g.ravel().astype(np.int32)], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([None if g is None else g.shape[k]], pa.int32()) for k in (1, 0))], names=["path", "lum", "w", "h"])

    return files.join(pixels, "path", "left").mapInArrow(run, schema)


def _as_row(g: np.ndarray) -> tuple:
    return g.ravel().astype(int).tolist(), g.shape[1], g.shape[0]


def enlarge(df: DataFrame, keep: Sequence[str] = ("path",), longest: int = RETRY_EDGE) -> DataFrame:
    """Grids enlarged for a second look; null where that would hardly make them larger."""
    def kernel(g: np.ndarray):
        big = G.enlarged(g, longest)
        return None if big is None else _as_row(big)

    return G.on_grids(df.withColumnsRenamed({"w": "_w", "h": "_h", "lum": "_lum"}), "_lum", "_w", "_h", [*keep], T.StructType(_GRID), kernel)


def display_crops(df: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep, lum, w, h, warped, skew, cleaned, remarks): the display of each photo, with its glare filled in as ``cleaned``."""
    out = T.StructType([*_GRID, T.StructField("warped", T.BooleanType()), T.StructField("skew", T.DoubleType()), T.StructField("cleaned", T.ArrayType(T.IntegerType())), T.StructField("remarks", T.ArrayType(T.StringType()))])

    def kernel(g: np.ndarray):
        found = G.display_crop(g)
        if found is None:
            return None
        crop, warped, skew = found
        clean, regions, covered = G.without_glare(crop)
        said = [WARPED % skew if warped else NOT_WARPED % (skew, G.WARP_DEGREES)] + ([GLARE % (regions, 100 * covered)] if regions else [])
        return *_as_row(crop), warped, skew, clean.ravel().astype(int).tolist(), said

    crops = G.on_grids(df.withColumnsRenamed({"w": "_w", "h": "_h", "lum": "_lum"}), "_lum", "_w", "_h", [*keep], out, kernel)
    return crops.where("lum is not null")


def crop_variants(crops: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep, rung, variant, lum, w, h) of every crop and preparation, each made where it is looked at."""
    slim = crops.select(*keep, F.when(F.col("warped"), "WARP").otherwise("crop").alias("rung"), F.col("cleaned").alias("_lum"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    parts = [G.on_grids(slim, "_lum", "_w", "_h", [*keep, "rung"], T.StructType(_GRID), lambda g, v=v: _as_row(G.preprocess(g, v))).withColumn("variant", F.lit(v)) for v in CROP_VARIANTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def load_dictionary(spark: SparkSession, path: str):
    """A broadcast list of a dictionary file's characters; their order is the class index, so the file is read whole, once."""
    return spark.sparkContext.broadcast(read_dictionary(spark.read.text(path, wholetext=True).first()[0]))


def two_stage_engine(detect: Callable[[np.ndarray], np.ndarray], read: Callable[[np.ndarray], np.ndarray], chars: Sequence[str], most: int = MOST_BOXES) -> Callable[[np.ndarray], list[tuple]]:
    """An engine out of a detector (grid to a map of text probability) and a reader (grid of 48 rows to class scores).

    Boxes of text are cut out upright, read, and given as lines (text, left, top, right, bottom, confidence) in reading
    order; boxes that read as nothing are left out. Both models come from outside, as weights aren't public here.
    """
    def run(g: np.ndarray) -> list[tuple]:
        prob = detect(g)
        lines = []
        for corners, _ in text_boxes(prob, g.shape[1] / prob.shape[1], g.shape[0] / prob.shape[0])[:most]:
            p = np.array(corners)
            w, h = (max(1, round(float(np.hypot(*(p[a] - p[b]))))) for a, b in ((1, 0), (3, 0)))
            part = G.warp(g, corners, max(w, 2), max(h, 2))
            width = int(np.clip(-(-READER_HEIGHT * part.shape[1] // part.shape[0]), *READER_WIDTHS))
            text, confidence = ctc_text(read(G.resize(part, width, READER_HEIGHT)), [*chars])
            if text:
                left, top, right, bottom = (int(np.floor(x + 0.5)) for x in (*p.min(0), *p.max(0)))
                lines.append((text, left, top, right, bottom, confidence))
        return sorted(lines, key=lambda x: (x[2], x[1]))

    return run
