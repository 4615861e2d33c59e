"""The retry ladder: ordered observations of a photo fill what earlier ones left empty, with events and provenance.

An observation is what one engine (or the segment decoder) made of one variant of the photo at one rung. Rungs
fill empty fields only, so a rung runs while something is missing, and what was missing follows from the earlier
observations alone: all is windows over a run's observations (a dozen at most) and one aggregation, no loop.

Defined results: an observation without lines leaves no event and fills nothing; ties of the order go by rung,
engine and variant; a run without observations has no row; a null value is one not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import spatial as S
from ..functions.decoders import read_segments
from ..functions.raster import on_grids
from ..schemas import FIELDS
from . import fuse
from .parse import VALUES, anchor_for, parse_lines

#: Engine name of the segment decoder, its least confidence, names of passes and variants.
SEGMENT_ENGINE = "7seg"
SEGMENT_CONFIDENCE = 0.75
PASS1, ENSEMBLE, REGION = "pass1", "pass1-ensemble", "anchor-region"
ORIGINAL = "ORIGINAL"
CROP_VARIANTS = ("CLAHE_STRETCH", "MORPH_CLOSE_BIN", "ILLUM_FLAT_ADAPTIVE")
RETRY_ENGINES = ("paddle", "mlkit")
SEGMENT_TEXT = '%s: segment-decoded region below anchor "%s" → "%s"'


def rungs(warped: bool = False) -> list[tuple[str, str, str]]:
    """(rung, engine, variant) in the order in which a run that stays incomplete goes through them after pass 1."""
    crop = "WARP" if warped else "crop"
    out = [("retry-highres", e, ORIGINAL) for e in RETRY_ENGINES]
    out += [(crop, e, v) for v in CROP_VARIANTS for e in RETRY_ENGINES]
    out += [("segment-decode", SEGMENT_ENGINE, crop), (REGION, SEGMENT_ENGINE, crop), ("segment-decode", SEGMENT_ENGINE, ORIGINAL),
            ("segment-decode-highres", SEGMENT_ENGINE, ORIGINAL), (REGION, SEGMENT_ENGINE, ORIGINAL)]
    return out


def pass_name(rung: Column, engine: Column, variant: Column) -> Column:
    """What notes call an observation."""
    return (F.when(rung == "segment-decode-highres", "segment-decode (high-res)")
            .when(rung == "segment-decode", F.when(variant == ORIGINAL, "segment-decode").otherwise(F.concat(F.lit("segment-decode ("), variant, F.lit(")"))))
            .otherwise(F.concat(rung, F.lit("/"), engine)))


def climb(obs: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Observations (key, order, rung, engine, variant, odo, battery, range, lines, notes) with what became of them.

    Adds ran, produced, accepted and discarded. Pass 1 always runs; a later rung runs while a field is missing and if it
    has lines; the region rung only if it fills something.
    """
    w = W.partitionBy(*key).orderBy(order, "rung", "engine", "variant").rowsBetween(W.unboundedPreceding, -1)
    had = {f: F.count(f).over(w) > 0 for f in FIELDS}
    o = obs.withColumns({f"_had_{f}": had[f] for f in FIELDS}).withColumn("_first", F.count(F.lit(1)).over(w) == 0)
    missing = ~(F.col("_had_odo") & F.col("_had_battery") & F.col("_had_range"))
    new = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & ~F.col(f"_had_{f}"), F.lit(f)) for f in FIELDS)))
    region = F.col("rung") == REGION
    ran = F.col("_first") | missing & F.when(region, F.size(new) > 0).otherwise(F.size("lines") > 0)
    o = o.withColumn("ran", ran).withColumn("accepted", F.when(F.col("ran"), new).otherwise(F.array().cast("array<string>")))
    seen = F.when(region, F.col("accepted")).otherwise(fuse.fields_present(*(F.col(f) for f in FIELDS)))
    o = o.withColumn("produced", F.when(F.col("ran"), seen).otherwise(F.array().cast("array<string>")))
    return o.withColumn("discarded", F.array_except("produced", "accepted")).drop("_first", *(f"_had_{f}" for f in FIELDS))


def ladder_run(obs: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """One row per run: values, provenance, rungEvents, lines, notes, remarks, engines, sources and debugJson.

    A field's provenance is the observation that filled it; its confidence is pass 1's and null for every later rung.
    Notes of a rung stand behind those of what it recovered, remarks behind all notes. Optional columns: ``confidence`` (a
    map by field), ``engines`` of pass 1 (default: its engine), ``remarks`` (of the ensemble, the crop, the glare mask).
    """
    o = climb(obs, key, order).where("ran")
    for c, t in (("confidence", "map<string,string>"), ("engines", "array<string>"), ("remarks", "array<string>")):
        o = o if c in o.columns else o.withColumn(c, F.lit(None).cast(t))
    name = pass_name(F.col("rung"), F.col("engine"), F.col("variant"))
    later = ~F.col("rung").isin(PASS1, ENSEMBLE)
    told = F.when(later & (F.col("rung") != REGION), F.concat(
        F.transform("accepted", lambda f: F.concat(f, F.lit(": recovered by "), name)), F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.concat(name, F.lit(": "), n)))).otherwise(F.col("notes"))
    lines = F.when(later, F.when(F.col("rung") == REGION, F.array().cast(o.schema["lines"].dataType)).otherwise(F.concat(F.array(fuse.separator(name)), "lines"))).otherwise(F.col("lines"))
    filled = {f: F.array_contains("accepted", f) for f in FIELDS}
    origin = {f: F.max(F.when(filled[f], F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), "engine", "variant", F.col("rung").alias("stage"),
                                                  F.when(~later, F.try_element_at("confidence", F.lit(f))).alias("confidence"), F.col(order).alias("ord")))) for f in FIELDS}
    event = F.struct(F.col(order).alias("ord"), F.struct("rung", "engine", "variant", "produced", "accepted").alias("event"), told.alias("notes"), lines.alias("lines"),
                     F.when(~later, F.coalesce("engines", F.array("engine"))).alias("engines"), "remarks")
    g = o.groupBy(*key).agg(*(c.alias(f"_{f}") for f, c in origin.items()), F.array_sort(F.collect_list(event)).alias("_e"))
    each = lambda c: F.transform("_e", lambda e: e[c])
    # fields in the order in which they were filled
    bare = lambda x: F.struct(*(x[c].alias(c) for c in ("field", "value", "engine", "variant", "stage", "confidence")))
    entries = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"_{f}").isNotNull(), F.struct(F.col(f"_{f}.ord").alias("ord"), F.lit(n).alias("n"), F.lit(f).alias("key"), bare(F.col(f"_{f}")).alias("value")))
                                                     for n, f in enumerate(FIELDS)))))
    g = g.select(*key, *(F.col(f"_{f}.value").alias(f) for f in FIELDS), F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"], x["value"]))).alias("provenance"),
                 each("event").alias("rungEvents"), F.flatten(each("lines")).alias("lines"), F.flatten(F.array_compact(each("notes"))).alias("notes"),
                 F.flatten(F.array_compact(each("remarks"))).alias("remarks"), F.flatten(F.array_compact(each("engines"))).alias("engines"))
    g = g.withColumns({"sources": F.transform_values("provenance", lambda _, p: fuse.provenance_text(p)), "debugJson": fuse.provenance_json(F.col("provenance"), F.col("engines"), F.col("remarks"))})
    return g.withColumn("notes", F.concat("notes", "remarks"))


def _decode(df: DataFrame, key: list[str], box: str, pixels: str, width: str, height: str) -> DataFrame:
    """Adds ``seg`` struct<text,confidence> of the digits in a box of the row's grid; null where the box is, or nothing decodes."""
    cut = df.where(F.col(box).isNotNull() & F.col(pixels).isNotNull())
    w, h = F.col(box)["right"] - F.col(box)["left"], F.col(box)["bottom"] - F.col(box)["top"]
    rows = F.sequence(F.col(box)["top"], F.col(box)["bottom"] - 1)
    part = F.flatten(F.transform(rows, lambda y: F.slice(pixels, y * F.col(width) + F.col(box)["left"] + 1, w)))
    cut = cut.where((w >= 8) & (h >= 8)).select(*key, w.alias("_w"), h.alias("_h"), part.alias("_px"))
    got = on_grids(cut, "_px", "_w", "_h", key, _SEGMENT, read_segments)
    return df.join(got.select(*key, F.struct("text", "confidence").alias("seg")), key, "left")


def _segment_schema():
    from pyspark.sql import types as ST

    return ST.StructType([ST.StructField("text", ST.StringType()), ST.StructField("confidence", ST.DoubleType())])


_SEGMENT = _segment_schema()


def repair_lines(df: DataFrame, key: list[str], lines: str = "lines", pixels: str = "lum", width: str = "w", height: str = "h") -> DataFrame:
    """Lines with digits read anew from their padded boxes by the segment decoder; only rows where a text changed stay.

    Boxes without digits are never cut out, so nothing of a photo reaches the decoder but what it may mend.
    """
    d = df.select(*key, pixels, width, height, F.posexplode(lines).alias("_at", "_line"))
    has_digit = F.col("_line.text").rlike(r"\p{Nd}")
    d = d.withColumn("_box", F.when(has_digit, S.padded_box(F.col("_line"), F.col(width), F.col(height))))
    d = _decode(d, [*key, "_at"], "_box", pixels, width, height)
    text = F.when(F.col("seg.confidence") >= SEGMENT_CONFIDENCE, F.col("seg.text")).otherwise(F.col("_line.text"))
    d = d.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_line").withField("text", text).alias("line"), (~text.eqNullSafe(F.col("_line.text"))).alias("changed")))).alias("_l"))
    return d.where(F.exists("_l", lambda x: x["changed"])).select(*key, F.transform("_l", lambda x: x["line"]).alias(lines))


def read_regions(df: DataFrame, key: list[str], lines: str = "lines", pixels: str = "lum", width: str = "w", height: str = "h") -> DataFrame:
    """(key, odo, battery, range, notes): values decoded under the anchors of the fields that are still null in ``df``."""
    d = df.where(F.size(lines) > 0)
    for f in FIELDS:
        d = anchor_for(d, lines, f, f"_a_{f}")
    one = lambda f: F.when(F.col(f).isNull() & F.col(f"_a_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("anchor")))
    d = d.select(*key, pixels, width, height, F.explode(F.array_compact(F.array(*map(one, FIELDS)))).alias("_f")).select(*key, pixels, width, height, "_f.*")
    d = _decode(d.withColumn("_box", S.region_below(F.col("anchor"), F.col(width), F.col(height))), [*key, "field"], "_box", pixels, width, height)
    d = d.where(F.col("seg.confidence") >= SEGMENT_CONFIDENCE).select(*key, "field", "anchor.text", F.col("seg.text").alias("read"))
    value = lambda f: F.max(F.when(F.col("field") == f, VALUES[f](F.upper("read"))))
    place = F.when(F.col("field") == "odo", 0).when(F.col("field") == "battery", 1).otherwise(2)
    note = F.struct(place.alias("n"), F.format_string(SEGMENT_TEXT, "field", "text", "read").alias("note"))
    return d.groupBy(*key).agg(*(value(f).alias(f) for f in FIELDS), F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]).alias("notes"))


def observe(recognised: DataFrame, key: list[str], lines: str = "lines") -> DataFrame:
    """Recognised observations (key, ord, rung, engine, variant, lines), each parsed on its own."""
    return parse_lines(recognised, lines)
