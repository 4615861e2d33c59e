"""File sources: image folders, truth files, orientation, dictionaries, and pluggable recognisers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Endings of image files and the name of a truth file.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "heic")
TRUTH_NAME = "ground_truth.csv"
LINES = "array<struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>>"


def display_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: The first bytes of image files (JPEG, PNG, GIF, BMP, then WebP and HEIC behind a length).
IMAGE_MAGIC = "^(FFD8FF|89504E470D0A1A0A|474946383|424D|52494646.{8}57454250|.{8}66747970(686569|6D6966))"


def file_ending(name: Column) -> Column:
    """The ending behind the last full stop, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def list_folder(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Direct children that are images or truth files: (path, name, length, content).

    Images are told by their ending or, where the content is asked for, by their first bytes; else no bytes are read.
    """
    d = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*")
    name = display_name(F.col("path"))
    listed = file_ending(name).isin(*IMAGE_ENDINGS) | (F.lower(name) == TRUTH_NAME)
    if content:
        listed = listed | F.hex(F.substring("content", 1, 12)).rlike(IMAGE_MAGIC)
    return d.where(listed).select("path", name.alias("name"), "length", *(["content"] if content else []))


def split_inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, images): the first truth file by path is the truth, further ones stay among the images."""
    named = F.lower("name") == TRUTH_NAME
    n = F.row_number().over(W.partitionBy("_truth").orderBy("path"))  # few files bear that name
    marked = files.where(named).withColumn("_truth", F.lit(1)).withColumn("_n", n)
    truth = marked.where("_n = 1").drop("_truth", "_n")
    images = files.where(~named).unionByName(marked.where("_n > 1").drop("_truth", "_n"))
    return truth, images


def image_hashes(images: DataFrame) -> DataFrame:
    """(path, name, hash): SHA-256 of each file's bytes, null for an unreadable one."""
    return images.select("path", "name", F.sha2("content", 256).alias("hash"))


def exif_orientation(data: bytes | None) -> int:
    """The orientation tag (1 to 8) of a JPEG, 1 if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2:at + 4])[0]
        if marker == 0xE1 and data[at + 4:at + 10] == b"Exif\0\0":
            tiff = data[at + 10:at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack_from(order + "I", tiff, 4)[0]
                for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
                    tag, kind = struct.unpack_from(order + "HH", tiff, start + 2 + 12 * k)
                    if tag == 0x0112 and kind == 3:
                        v = struct.unpack_from(order + "H", tiff, start + 10 + 12 * k)[0]
                        return v if 1 <= v <= 8 else 1
            except struct.error:
                return 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def scaled_size(width: int, height: int, longest: int) -> tuple[int, int]:
    """The size whose longer edge is at most ``longest``."""
    k = min(1.0, longest / max(width, height, 1))
    return max(1, round(width * k)), max(1, round(height * k))


def read_dictionary(text: str) -> list[str]:
    """Characters of a dictionary file; their order is the class index."""
    return text.rstrip("\n").split("\n")


def recognise(images: DataFrame, engines: dict[str, Callable[[bytes], Sequence[tuple]]], keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep..., engine, lines) for each image and engine; an engine that fails gives an empty list, never a failed task.

    ``engines`` maps a name to a function from bytes to lines (text, left, top, right, bottom, confidence).
    """
    slim = images.select(*keep, "content")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "content"), f"engine string, lines {LINES}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                for name, engine in engines.items():
                    try:
                        lines = [dict(zip(("text", "left", "top", "right", "bottom", "confidence"), x)) for x in engine(r["content"])]
                    except Exception:  # noqa: BLE001 - one bad image or engine must not end the job
                        lines = []
                    rows.append({**{k: r[k] for k in keep}, "engine": name, "lines": lines})
            yield pd.DataFrame(rows, columns=[*keep, "engine", "lines"])

    return slim.mapInPandas(run, schema)
