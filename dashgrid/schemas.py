"""Schemas and closed domains of the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields, modes, rungs of the retry ladder, variants, tiebreak rules.
FIELDS = ("odo", "battery", "range")
MODES = ("ML_KIT", "PADDLE", "BOTH")
RUNGS = ("pass1", "pass1-ensemble", "retry-highres", "crop", "WARP", "segment-decode", "segment-decode-highres", "anchor-region")
TIEBREAKS = ("sanity check", "higher OCR confidence", "engine preference", "primary engine fallback")
ENGINES = {"ML_KIT": ("mlkit",), "PADDLE": ("paddle",), "BOTH": ("mlkit", "paddle")}
DEFAULT_MODE = "BOTH"
MOST_IMAGES, MOST_BOXES = 100, 64
EVENT_TYPES = ("CHARGE_START", "CHARGE_END", "MANUAL")

READING = """id bigint, timestamp bigint, odoKm int, batteryPct int, rangeKm int, eventType string, userEdited boolean,
 ocrOdo int, ocrBattery int, ocrRange int, imagePath string, synced boolean, debugJson string, imageHash string"""
OCR_LINE = "struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>"
ENTRY = "struct<filename:string,odo:int,battery:int,range:int,corrected:boolean>"


def dimension(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    """A closed domain as rows (ord, name)."""
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, {name})")


def inside(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def mode_or_default(c: Column) -> Column:
    """A stored mode; missing and unknown ones are the default."""
    return F.when(c.isin(*MODES), c).otherwise(DEFAULT_MODE)


def engines_of(mode: Column) -> Column:
    """The engines of a mode, the primary one first."""
    arrays = {m: F.array(*map(F.lit, e)) for m, e in ENGINES.items()}
    return F.when(mode == "ML_KIT", arrays["ML_KIT"]).when(mode == "PADDLE", arrays["PADDLE"]).otherwise(arrays["BOTH"])


def any_changed(a: Column, b: Column) -> Column:
    """Whether two arrays differ at some place both have."""
    return F.exists(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: (i < F.least(F.size(a), F.size(b))) & ~F.get(a, i).eqNullSafe(F.get(b, i)))
