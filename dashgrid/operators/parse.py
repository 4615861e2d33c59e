"""Fields out of positioned text: fuzzy anchors, merged lines, nearest values, standalone fallbacks.

Every step is a projection of higher-order functions over a row's lines; the indices already used are
carried along, as the order of the fields matters. Labels are looked for first; only lines that are free
and near an anchor are read for a value. Null or empty lines give null fields; a line's null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial as S
from ..functions import text as T

#: Labels of the fields, labels of other values, the longest label line, the notes on what was found.
LABELS = {"battery": ("BATTERY", "BATT"), "range": ("RANGE",)}
ODO_LABELS = ("ODO", "TOTAL")
OTHER_LABELS = ("TRIP", "CURRENT", "AVG", "SPEED", "RANGE", "BATTERY", "BATT", "RIDE", "MIN")
ANCHOR_CHARS = 24
MERGED = '%s: taken from merged line "%s"'
NEAREST = '%s: %s match "%s"'
NOTHING_NEAR = '%s: anchor "%s" found but no nearby numeric line'
NO_ANCHOR = "%s: no anchor found"
NO_ODO_ANCHOR = "odo: no ODO anchor found — not falling back to largest number (speed trap)"
TOLERANT = 'odo: anchor matched via OCR-tolerant pattern ("%s")'
LONE = {"battery": 'battery: no BATTERY label; standalone percentage line "%s"', "odo": 'odo: no label; lone "value km" line "%s"'}
AMBIGUOUS = {"battery": "battery: multiple standalone % lines, ambiguous — skipped", "odo": 'odo: multiple unlabeled "value km" lines, ambiguous — skipped'}

VALUES = {"battery": T.battery_value, "range": T.range_value, "odo": T.odo_value}


def _prepared(lines: Column) -> Column:
    """Lines as struct<i,text,words,left,top,right,bottom>, their text normalised and its words cut once."""
    named = F.transform(lines, lambda x: F.struct(T.normalise_line(F.coalesce(x["text"], F.lit(""))).alias("t"), x.alias("b")))
    return F.transform(named, lambda x, i: F.struct(i.alias("i"), x["t"].alias("text"), T.tokens(x["t"]).alias("words"), *(x["b"][c].alias(c) for c in ("left", "top", "right", "bottom"))))


def _odo_like(token: Column) -> Column:
    return T.token_matches(token, "ODO") | T.token_matches(token, "TOTAL")


def _anchors(d: DataFrame) -> DataFrame:
    """Adds the anchor line of each field (``a_<field>``) and whether the odometer's was misread (``_misread``)."""
    first = lambda test: F.get(F.filter("_lines", lambda x: (F.length(x["text"]) <= ANCHOR_CHARS) & test(x)), F.lit(0))
    d = d.withColumns({f"a_{f}": first(lambda x, f=f: T.line_matches(x["text"], LABELS[f], x["words"])) for f in LABELS})
    d = d.withColumn("_exact", first(lambda x: x["text"].contains(ODO_LABELS[0]) | x["text"].contains(ODO_LABELS[1])))
    d = d.withColumn("_like", F.when(F.col("_exact").isNull(), first(lambda x: F.exists(x["words"], _odo_like))))
    # words of a misread label must not be read as part of the value
    rest = F.array_join(F.filter(F.split("_like.text", r"\s+"), lambda w: ~F.exists(T.tokens(w), _odo_like)), " ")
    d = d.withColumns({"_misread": F.col("_like.text"), "a_odo": F.coalesce("_exact", F.when(F.col("_like").isNotNull(), F.col("_like").withField("text", rest)))})
    return d.drop("_exact", "_like")


def anchor_for(df: DataFrame, lines: str, field: str, out: str = "anchor") -> DataFrame:
    """Adds a field's anchor line as struct<text,left,top,right,bottom>, null if there is none (or no such field)."""
    if field not in VALUES:
        return df.withColumn(out, F.lit(None).cast("struct<text:string,left:int,top:int,right:int,bottom:int>"))
    a = F.col(f"a_{field}")
    d = _anchors(df.withColumn("_lines", _prepared(F.col(lines))))
    return d.select(*df.columns, F.when(a.isNotNull(), F.struct(*(a[c].alias(c) for c in ("text", "left", "top", "right", "bottom")))).alias(out))


def _use(at: Column) -> Column:
    return F.when(at.isNotNull(), F.array_union("_used", F.array(at))).otherwise(F.col("_used"))


def _note(*cases: tuple[Column, Column]) -> Column:
    """The notes, with that of the first case that holds."""
    note = F.coalesce(*(F.when(c, n) for c, n in cases))
    return F.when(note.isNull(), F.col("notes")).otherwise(F.array_append("notes", note))


def _extract(d: DataFrame, field: str) -> DataFrame:
    """Adds the field: from the anchor's own line, else from the nearest free line below or beside it."""
    a, value = F.col(f"a_{field}"), VALUES[field]
    d = d.withColumn("_own", F.when(a.isNotNull(), value(a["text"])))
    near = F.filter("_lines", lambda x: ~F.array_contains("_used", x["i"]) & ~F.array_contains("_reserved", x["i"]) & S.below_or_beside(a, x))
    d = d.withColumn("_near", F.when(a.isNotNull() & F.col("_own").isNull(), near))
    read = F.transform("_near", lambda x: F.struct(S.distance(a, x).alias("d"), x["i"].alias("i"), value(x["text"]).alias("v"), S.relation(a, x).alias("how"), x["text"].alias("text")))
    d = d.withColumn("_near", read).withColumn("_near", F.array_min(F.filter("_near", lambda x: x["v"].isNotNull())))
    own, best = F.col("_own"), F.col("_near")
    return d.withColumns({
        field: F.coalesce(own, best["v"]), "_used": _use(F.coalesce(F.when(own.isNotNull(), a["i"]), best["i"])),
        "notes": _note((own.isNotNull(), F.format_string(MERGED, F.lit(field), a["text"])), (best.isNotNull(), F.format_string(NEAREST, F.lit(field), best["how"], best["text"])),
                       (a.isNotNull(), F.format_string(NOTHING_NEAR, F.lit(field), a["text"])), (a.isNull() & F.lit(field != "odo"), F.lit(NO_ANCHOR % field))),
    }).drop("_own", "_near")


def _lone(d: DataFrame, field: str, test) -> DataFrame:
    """Fills a field that has no label from the only free line of its form; several are ambiguous, whatever their values."""
    free = F.filter("_lines", lambda x: ~F.array_contains("_used", x["i"]) & ~F.array_contains("_reserved", x["i"]) & test(x))
    d = d.withColumn("_c", F.when(F.col(f"a_{field}").isNull(), free))
    d = d.withColumn("_one", F.when(F.size("_c") == 1, F.get("_c", F.lit(0)))).withColumn("_v", VALUES[field](F.col("_one.text")))
    got = F.col("_v").isNotNull()
    return d.withColumns({
        field: F.coalesce(field, "_v"), "_used": _use(F.when(got, F.col("_one.i"))),
        "notes": _note((got, F.format_string(LONE[field], F.col("_one.text"))), (F.size("_c") > 1, F.lit(AMBIGUOUS[field]))),
    }).drop("_c", "_one", "_v")


def parse_lines(df: DataFrame, lines: str) -> DataFrame:
    """Adds odo, battery, range and notes to rows with an ``array<struct<text,left,top,right,bottom,confidence>>``."""
    d = _anchors(df.withColumn("_lines", _prepared(F.col(lines))))
    d = d.withColumns({
        "_reserved": F.array_compact(F.array("a_odo.i", "a_battery.i", "a_range.i")), "_used": F.array().cast("array<int>"),
        "notes": F.array_compact(F.array(F.when(F.col("_misread").isNotNull(), F.format_string(TOLERANT, F.col("_misread"))))),
    })
    d = _lone(_extract(d, "battery"), "battery", lambda x: T.is_bare_percent(x["text"]))
    d = _extract(_extract(d, "range"), "odo")
    d = d.withColumns({"notes": _note((F.col("a_odo").isNull(), F.lit(NO_ODO_ANCHOR))),
                       "_labels": F.when(F.col("a_odo").isNull(), F.filter("_lines", lambda x: T.line_matches(x["text"], OTHER_LABELS, x["words"])))})
    d = _lone(d, "odo", lambda x: T.is_bare_odo(x["text"]) & ~F.exists("_labels", lambda b: (b["i"] != x["i"]) & S.directly_below(b, x)))
    return d.select(*df.columns, "odo", "battery", "range", "notes")
