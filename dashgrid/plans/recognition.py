"""Queries of the text, fusion and raster layers over frames derived from the star schema, with their oracle SQL.

The tables hold no recognised lines or photos, so positioned lines are derived from lineitem (a case is an
order), pixel grids and class scores from embeddings, by rules both engines evaluate alike.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import decoders as D, raster as G, spatial as S, text as X
from ..operators import fuse, ladder as R, readings as V
from ..operators.parse import LABELS, OTHER_LABELS, parse_lines
from ..schemas import FIELDS, any_changed
from ..session import table

_TEXTS = {
    0: "'ODO'", 1: "'ODO ' || (10000 + l_suppkey * 7 % 80000) || ' km'", 2: "'BATTERY'", 3: "' Batt ' || (l_partkey % 131) || '%'", 4: "'RANGE'", 5: "'RAN6E'",
    6: "(l_partkey % 300) || ' KM'", 7: "(l_partkey % 120) || ' %'", 8: "'0D0 km'", 9: "'L2' || (l_suppkey % 1000) || 'km'", 10: "'TRIP A'", 11: "'T0TAL 12 ' || (100 + l_suppkey % 900)",
    12: "'1O' || (l_suppkey % 10) || ' %'", 13: "'12,' || (100 + l_partkey % 900) || ' km'", 14: "'SPEED 47'", 15: "'1.' || (l_suppkey % 1000) || '.' || (l_partkey % 1000)",
}
LINES = f"""SELECT l_orderkey AS case_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INT) AS i,
 CASE l_partkey % 16 {' '.join(f'WHEN {k} THEN {v}' for k, v in _TEXTS.items())} END AS text,
 CAST(l_suppkey % 5 * 60 AS INT) AS x0, CAST((l_linenumber - 1) * 45 + l_partkey % 7 AS INT) AS y0, CAST(l_suppkey % 5 * 60 + 90 + l_partkey % 40 AS INT) AS x1,
 CAST((l_linenumber - 1) * 45 + l_partkey % 7 + 36 AS INT) AS y1, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_suppkey % 64 AS FLOAT) / 64 END AS confidence FROM """


def ocr_lines(s: SparkSession, d: str) -> DataFrame:
    return s.sql(LINES + "{lineitem}", lineitem=table(s, d, "lineitem"))


def ocr_cases(s: SparkSession, d: str) -> DataFrame:
    """(case_id, lines): a case's lines in order; an order has a handful of lines, so the arrays are small."""
    line = F.struct("i", "text", F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x1").alias("right"), F.col("y1").alias("bottom"), F.col("confidence").cast("float").alias("confidence"))
    return ocr_lines(s, d).groupBy("case_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def text_normalize(s: SparkSession, d: str) -> DataFrame:
    t = X.normalise_line(F.col("text"))
    return ocr_lines(s, d).select("case_id", "i", t.alias("line"), F.array_join(X.tokens(t), "|").alias("tokens"), X.fold_digits(t).alias("folded"))


def fuzzy_label_match(s: SparkSession, d: str) -> DataFrame:
    t = X.normalise_line(F.col("text"))
    return ocr_lines(s, d).select("case_id", "i", *(X.line_matches(t, labels).alias(n) for n, labels in (("odo", ("ODO", "TOTAL")), ("battery", ("BATTERY", "BATT")), ("range_", ("RANGE",)))))


def digit_repair(s: SparkSession, d: str) -> DataFrame:
    return ocr_lines(s, d).select("case_id", "i", X.repair_digits(X.normalise_line(F.col("text"))).alias("repaired"))


def field_value_parsers(s: SparkSession, d: str) -> DataFrame:
    t, r = F.col("t"), F.col("r")  # each line is normalised and repaired once
    o = ocr_lines(s, d).withColumn("t", X.normalise_line(F.col("text"))).withColumn("r", X.repair_digits(t))
    return o.select("case_id", "i", X.battery_value(r, True).alias("battery"), X.range_value(r, True).alias("range_"), X.odo_value(r, True).alias("odo"),
                    X.is_bare_percent(t).alias("bare_percent"), X.is_bare_odo(t).alias("bare_odo"))


def separator_normalize(s: SparkSession, d: str) -> DataFrame:
    return ocr_lines(s, d).select("case_id", "i", X.normalise_separators(F.col("text")).alias("shown"))


def line_boxes(s: SparkSession, d: str) -> DataFrame:
    """Each line's box as text, its padded box and the region where its value is expected, in an image of 360 x 320."""
    b = F.struct(F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("x1").alias("right"), F.col("y1").alias("bottom"))
    size = (F.lit(360), F.lit(320))
    text = lambda r: F.when(r.isNotNull(), S.box_text(r))
    return ocr_lines(s, d).select("case_id", "i", S.box_text(b).alias("box"), text(S.padded_box(b, *size)).alias("padded"), text(S.region_below(b, *size)).alias("below"))


def nearest_value(s: SparkSession, d: str) -> DataFrame:
    """Per case, the line nearest to the first RANGE label among those below or beside it; the lower index wins ties."""
    c = ocr_cases(s, d).withColumn("a", F.get(F.filter("lines", lambda x: x["text"] == "RANGE"), F.lit(0))).where("a is not null")
    a = F.col("a")
    near = F.array_min(F.transform(F.filter("lines", lambda x: (x["i"] != a["i"]) & S.below_or_beside(a, x)), lambda x: F.struct(S.distance(a, x).alias("d"), x["i"].alias("i"), S.relation(a, x).alias("how"))))
    return c.select("case_id", near.alias("n")).select("case_id", F.col("n.i").alias("nearest"), F.col("n.how").alias("how"))


def dashboard_parse(s: SparkSession, d: str) -> DataFrame:
    """Fields of every case."""
    return parse_lines(ocr_cases(s, d), "lines").select("case_id", "odo", "battery", "range", F.array_join("notes", "; ").alias("notes"))


#: What the k-th case of a photo stands for: rung, engine, variant.
_PLACES = (("pass1", "mlkit", "ORIGINAL"), ("retry-highres", "paddle", "ORIGINAL"), ("retry-highres", "mlkit", "ORIGINAL"), ("crop", "paddle", "CLAHE_STRETCH"), ("crop", "mlkit", "MORPH_CLOSE_BIN"),
           ("segment-decode", "7seg", "crop"), ("segment-decode-highres", "7seg", "ORIGINAL"), ("anchor-region", "7seg", "ORIGINAL"))


def observations(s: SparkSession, d: str) -> DataFrame:
    """Every eight successive cases are the observations of one photo, in the order of the ladder."""
    place = F.get(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("rung", "engine", "variant"), p))) for p in _PLACES)), (F.col("case_id") % 8).cast("int"))
    o = ocr_cases(s, d).select(F.expr("case_id div 8").alias("photo"), (F.col("case_id") % 8).alias("ord"), place.alias("p"), F.transform("lines", lambda x: x.dropFields("i")).alias("lines"))
    return R.observe(o.select("photo", "ord", "p.*", "lines"), ["photo"])


def ladder_run(s: SparkSession, d: str) -> DataFrame:
    """Values of every photo, the rungs that ran, what they had accepted, and the debug JSON."""
    r = R.ladder_run(observations(s, d), ["photo"])
    won = F.array_join(F.transform("rungEvents", lambda e: F.concat_ws(":", e["rung"], e["engine"], e["variant"], F.array_join(e["produced"], "|"), F.array_join(e["accepted"], "|"))), ";")
    return r.select("photo", *FIELDS, won.alias("events"), F.size("lines").alias("n_lines"), F.size("notes").alias("n_notes"), "debugJson")


def ladder_provenance(s: SparkSession, d: str) -> DataFrame:
    return R.ladder_run(observations(s, d), ["photo"]).select("photo", F.explode("sources").alias("field", "shown"))


def fill_empty_merge(s: SparkSession, d: str) -> DataFrame:
    """The first two observations of every photo that has both, as two passes."""
    part = lambda k, n: observations(s, d).where(F.col("ord") == k).select("photo", F.struct(*FIELDS, "lines", "notes").alias(n))
    m = part(0, "a").join(part(1, "b"), "photo").select("photo", fuse.fill_empty(F.col("a"), F.col("b"), "pass2 (high-res)").alias("m"))
    return m.select("photo", *(f"m.{f}" for f in FIELDS), F.array_join(F.transform("m.lines", lambda x: x["text"]), "|").alias("lines"), F.array_join("m.notes", "; ").alias("notes"))


def ensemble_lines(s: SparkSession, d: str) -> DataFrame:
    """The first two observations of every photo fused as two engines' results, with the confidences of their lines."""
    side = lambda k, n, engine: observations(s, d).where(F.col("ord") == k).select("photo", F.struct(engine.alias("engine"), *FIELDS, "lines").alias(n))
    both = side(0, "first", F.lit("mlkit")).join(side(1, "second", F.when(F.col("photo") % 2 == 0, "paddle").otherwise("other")), "photo")
    out = fuse.ensemble(both.withColumn("last_odo", F.lit(12_000)))
    return out.select("photo", *(F.col(f"{f}_outcome.{c}").alias(f"{f}_{c}") for f in FIELDS for c in ("value", "confidence", "engine", "tiebreak")))


def best_confidence(s: SparkSession, d: str) -> DataFrame:
    """Best confidence of the lines that hold a value that varies with the case."""
    return ocr_cases(s, d).select("case_id", fuse.line_confidence((F.col("case_id") % 100).cast("int"), F.col("lines")).cast("double").alias("confidence"))


def lines_changed(s: SparkSession, d: str) -> DataFrame:
    """Whether normalising changes some line of a case."""
    text = lambda f: F.transform("lines", lambda x: f(x["text"]))
    return ocr_cases(s, d).select("case_id", any_changed(text(lambda t: t), text(X.normalise_line)).alias("changed"))


def engine_panel(s: SparkSession, d: str) -> DataFrame:
    return ocr_cases(s, d).select("case_id", V.engine_text(F.lit("mlkit"), F.col("lines")).alias("shown"))


def debug_panel(s: SparkSession, d: str) -> DataFrame:
    sources = F.create_map(F.lit("odo"), F.concat(F.lit("7 ← "), F.col("case_id").cast("string")))
    return ocr_cases(s, d).select("case_id", V.debug_text(F.col("lines"), sources, F.array(F.lit("odo: a"), F.lit("range: b"))).alias("shown"))


def corner_order(s: SparkSession, d: str) -> DataFrame:
    """Top left, top right, bottom right, bottom left of four points taken from the first eight pixels of a grid."""
    out = ST.StructType([ST.StructField("corners", ST.StringType())])
    return G.on_grids(grids(s, d), "lum", "w", "h", ["vec_id"], out, lambda g: (_text(D.order_corners(g.ravel()[:8].reshape(4, 2))),))


def _rgb(g: np.ndarray) -> np.ndarray:
    return g.ravel()[:63].reshape(3, 7, 3)  # a picture of 7 x 3 pixels


def upper_median(s: SparkSession, d: str) -> DataFrame:
    return grids(s, d).select("vec_id", F.get(F.array_sort("lum"), F.expr("size(lum) div 2")).alias("median"))


def reading_order(s: SparkSession, d: str) -> DataFrame:
    """Line indices of each case by top, then left."""
    order = F.array_sort(F.transform("lines", lambda x: F.struct(x["top"].alias("t"), x["left"].alias("l"), x["i"].alias("i"))))
    return ocr_cases(s, d).select("case_id", F.array_join(F.transform(order, lambda x: x["i"].cast("string")), ",").alias("order_"))


def csv_cells(s: SparkSession, d: str) -> DataFrame:
    """File names and values of the entries written as CSV and split again."""
    e = table(s, d, "gt_entries")
    line = F.concat_ws(",", X.csv_escape(F.coalesce("filename", F.lit(""))), *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in ("odo", "battery", "range")))
    return e.select(line.alias("line")).select(X.csv_split(F.col("line")).alias("c")).select(*(F.get("c", F.lit(i)).alias(f"c{i}") for i in range(4)), F.size("c").alias("n"))


def quad_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of quadrilaterals whose corners are moved by the first eight components of an embedding."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    corners = F.array(*(F.struct((F.lit(float(x)) + F.floor(e(2 * k) * 16)).alias("x"), (F.lit(float(y)) + F.floor(e(2 * k + 1) * 16)).alias("y")) for k, (x, y) in enumerate(((0, 0), (90, 0), (90, 40), (0, 40)))))
    q = S.quad_metrics(corners)
    return table(s, d, "embeddings").select("vec_id", q.alias("q")).select("vec_id", "q.area", "q.box_area", F.round("q.width", 6).alias("width"), F.round("q.height", 6).alias("height"), F.round("q.skew", 6).alias("skew"), "q.degenerate")


def ctc_decode(s: SparkSession, d: str) -> DataFrame:
    """Eight steps of eight classes."""
    chars = D.charset(F.array(*map(F.lit, "123456")))
    out = D.ctc_greedy(F.col("embedding"), F.lit(8), F.lit(8), chars)
    return table(s, d, "embeddings").select("vec_id", out.alias("o")).select("vec_id", "o.text", F.round("o.confidence", 6).alias("confidence"))


def grids(s: SparkSession, d: str) -> DataFrame:
    """8 x 8 grids of luminance."""
    px = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int"))
    return table(s, d, "embeddings").select("vec_id", px.alias("lum"), F.lit(8).alias("w"), F.lit(8).alias("h"))


def _grid_query(fields: str, kernel, zoom: int = 1):
    """A query that applies a kernel to every grid, each pixel taken ``zoom`` times in both directions."""
    schema = ST.StructType([ST.StructField(n, t) for n, t in (((x.split()[0], {"int": ST.IntegerType(), "double": ST.DoubleType(), "string": ST.StringType()}[x.split()[1]])) for x in fields.split(","))])
    big = (lambda g: kernel(g.repeat(zoom, 0).repeat(zoom, 1).astype(np.int64)))
    return lambda s, d: G.on_grids(grids(s, d), "lum", "w", "h", ["vec_id"], schema, big)


def _text(g: np.ndarray) -> str:
    return ",".join(map(str, g.astype(int).ravel().tolist()))


def _glare(g: np.ndarray):
    r = G.inpaint_glare(np.where(g > 180, 255, g), least=0.01)
    return None if r is None else (_text(r[0]), r[1], r[2])


def _display(g: np.ndarray):
    r = G.bright_display(G.box_blur(g, 3))
    return None if r is None else (*r[0], str(r[1]))


def _boxes(g: np.ndarray):
    got = D.text_boxes(G.box_blur(g, 2) / 255.0, threshold=0.5, least=0.5)
    return len(got), max((s for _, s in got), default=None), json.dumps([[np.asarray(q).tolist(), float(s)] for q, s in got])


def _warp(g: np.ndarray):
    h, w = g.shape
    return (_text(G.warp(g, [(1.0, 0.0), (w - 2.0, 1.0), (w - 1.0, h - 1.0), (0.0, h - 2.0)], 8, 8)),)


def sharpness_gate(s: SparkSession, d: str) -> DataFrame:
    """Grids that count as blurred, by built-in expressions over the pixels: the Laplacian's population variance under 60."""
    p = lambda i: F.get("lum", i)
    inner = [y * 8 + x for y in range(1, 7) for x in range(1, 7)]
    lap = F.transform(F.array(*map(F.lit, inner)), lambda i: p(i - 8) + p(i + 8) + p(i - 1) + p(i + 1) - 4 * p(i))
    total = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lap, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    g = grids(s, d).select("vec_id", total.alias("t"), squares.alias("q")).select("vec_id", ((len(inner) * F.col("q") - F.col("t") * F.col("t")) / float(len(inner) ** 2)).alias("score"))
    return g.select("vec_id", F.round("score", 3).alias("score"), (F.col("score") < 60).alias("blurred"))


def laplacian_variance(s: SparkSession, d: str) -> DataFrame:
    """The sharpness kernel's score of every grid."""
    return _grid_query("score double", lambda g: (G.sharpness(g),))(s, d).select("vec_id", F.round("score", 3).alias("score"))


QUERIES = {
    "lines_changed": lines_changed, "engine_panel": engine_panel, "debug_panel": debug_panel, "corner_order": corner_order, "upper_median": upper_median,
    "luminance": _grid_query("lum string", lambda g: (_text(G.luminance(_rgb(g))),)),
    "tensor_normalise": _grid_query("symmetric string,natural string", lambda g: tuple(",".join(f"{int(np.floor(float(x) * 1000 + 0.5))}" for x in G.normalise(_rgb(g), k).ravel()) for k in (True, False))),
    "text_normalize": text_normalize, "fuzzy_label_match": fuzzy_label_match, "digit_repair": digit_repair, "field_value_parsers": field_value_parsers, "separator_normalize": separator_normalize,
    "line_boxes": line_boxes, "nearest_value": nearest_value, "dashboard_parse": dashboard_parse, "ladder_run": ladder_run, "ladder_provenance": ladder_provenance, "fill_empty_merge": fill_empty_merge, "ensemble_lines": ensemble_lines, "line_confidence": best_confidence, "reading_order": reading_order, "csv_cells": csv_cells,
    "quad_metrics": quad_metrics, "ctc_decode": ctc_decode, "sharpness_gate": sharpness_gate,
    "otsu": _grid_query("threshold int", lambda g: (G.otsu(g),)),
    "box_blur": _grid_query("blurred string", lambda g: (_text(G.box_blur(g, 1)),)),
    "gaussian_blur": _grid_query("blurred string", lambda g: (_text(G.gaussian5(g)),)),
    "adaptive_threshold": _grid_query("mask string", lambda g: (_text(G.adaptive_threshold(g, 3, 5)),)),
    "morph_close": _grid_query("mask string", lambda g: (_text(G.morph_close(g > 140, 1)),)),
    "laplacian_variance": laplacian_variance,
    "connected_components": _grid_query("components int,median_height int", lambda g: (G.label4(g > 127)[1], G.median_component_height(g > 127))),
    "clahe": _grid_query("equalised string", lambda g: (_text(G.clahe(g)),), 4),
    "illumination_flatten": _grid_query("flat string", lambda g: (_text(G.flatten_illumination(g)),)),
    "preprocess_variants": _grid_query("clahe string,closed string,adaptive string", lambda g: tuple(_text(G.preprocess(g, v)) for v in ("CLAHE_STRETCH", "MORPH_CLOSE_BIN", "ILLUM_FLAT_ADAPTIVE")), 4),
    "glare_inpaint": _grid_query("filled string,regions int,covered double", _glare, 4),
    "bright_region": _grid_query("x0 int,y0 int,x1 int,y1 int,corners string", _display, 4),
    "perspective_warp": _grid_query("warped string", _warp, 2),
    "db_boxes": _grid_query("boxes int,best double,found string", _boxes, 4),
    "segment_digits": _grid_query("digits string,confidence double", D.read_segments, 4),
}

_LINE_CTE = f"WITH o AS (SELECT *, regexp_replace(upper(text), '^\\s+|\\s+$', '', 'g') AS t FROM ({LINES} lineitem))"
_REPAIR = "array_to_string(list_transform(string_split({}, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN translate(w, 'OQDILZSGB', '000112568') ELSE w END), ' ')"
_TOKENS = "list_filter(string_split_regex({}, '[^A-Z0-9]+'), lambda x: x <> '')"


def _match_sql(labels: tuple[str, ...]) -> str:
    def one(x: str, label: str) -> str:
        most = 1 if len(label) <= 6 else 2
        short = f" AND length({x}) >= {len(label)}" if len(label) <= 4 else ""
        return f"(abs(length({x}) - {len(label)}) <= {most}{short} AND levenshtein(translate({x}, '012568', 'OIZSGB'), '{label}') <= {most})"

    exact = " OR ".join(f"contains(t, '{x}')" for x in labels)
    return f"({exact} OR len(list_filter({_TOKENS.format('t')}, lambda k: {' OR '.join(one('k', x) for x in labels)})) > 0)"


def _box_sql(*edges: str) -> str:
    return " || ".join(f"'{n}' || CAST({e} AS INTEGER)" for n, e in zip(("[L:", " T:", " R:", " B:"), edges)) + " || ']'"


_INT = "TRY_CAST(nullif(regexp_extract({}, '{}', 1), '') AS INTEGER)"
_ODO_TEXT = "regexp_replace(replace(replace(r, ',', ''), 'KM', ' '), '^\\s+|\\s+$', '', 'g')"
_GRID = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS INTEGER)) lum FROM embeddings)"
_PIX = f"{_GRID}, p AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, lum[i] AS v FROM g, range(1, 65) t(i))"


def _window_sql(agg_x: str, agg_y: str, src: str, r: int = 1) -> str:
    w = lambda part, order: f"OVER (PARTITION BY vec_id, {part} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    return f"SELECT vec_id, y, x, {agg_y.format('v', w('x', 'y'))} AS v FROM (SELECT vec_id, y, x, {agg_x.format('v', w('y', 'x'))} AS v FROM ({src}))"


_MEAN = "CAST(sum({0}) {1} AS BIGINT) // count(*) {1}"
_BLUR = _window_sql(_MEAN, _MEAN, "SELECT * FROM p")
_LIST = "string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)"
_CLOSE = _window_sql("min({0}) {1}", "min({0}) {1}", _window_sql("max({0}) {1}", "max({0}) {1}", "SELECT vec_id, y, x, CASE WHEN v > 140 THEN 1 ELSE 0 END AS v FROM p"))
_LAP = """SELECT p.vec_id, sum(a.v + b.v + c.v + d.v - 4 * p.v) t, sum((a.v + b.v + c.v + d.v - 4 * p.v) * (a.v + b.v + c.v + d.v - 4 * p.v)) q FROM p
 JOIN p a ON a.vec_id = p.vec_id AND a.y = p.y - 1 AND a.x = p.x JOIN p b ON b.vec_id = p.vec_id AND b.y = p.y + 1 AND b.x = p.x
 JOIN p c ON c.vec_id = p.vec_id AND c.y = p.y AND c.x = p.x - 1 JOIN p d ON d.vec_id = p.vec_id AND d.y = p.y AND d.x = p.x + 1 GROUP BY 1"""
_SCORE = f"SELECT vec_id, (36 * CAST(q AS BIGINT) - CAST(t AS BIGINT) * CAST(t AS BIGINT)) / 1296.0::DOUBLE AS score FROM ({_LAP})"
_C = [f"({x} + floor(CAST(embedding[{2 * k + 1}] AS DOUBLE) * 16))" for k, x in enumerate((0, 90, 90, 0))]
_R = [f"({y} + floor(CAST(embedding[{2 * k + 2}] AS DOUBLE) * 16))" for k, y in enumerate((0, 0, 40, 40))]
_AREA = "abs(" + " + ".join(f"x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i}" for i in range(4)) + ") / 2"
_SIDE = lambda i, j: f"sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j}))"
_FLAT = lambda i, j: f"abs(degrees(atan2(y{j} - y{i}, x{j} - x{i})))"
_STEEP = lambda i, j: f"abs(degrees(atan2(x{j} - x{i}, y{j} - y{i})))"
_BOX = "(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3)) * (greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3))"



def _values_sql(t: str) -> dict[str, str]:
    """Battery, range and odometer value of a text."""
    r = f"({_REPAIR.format(t)})"
    b = f"coalesce({_INT.format(r, _PCT)}, {_INT.format(r, _THREE)})"
    z = f"regexp_replace(replace(replace({r}, ',', ''), 'KM', ' '), '^\\s+|\\s+$', '', 'g')"
    z = f"CASE WHEN regexp_matches({z}, '^[0-9 .]+$') THEN replace({z}, ' ', '') ELSE {z} END"
    return {"battery": f"CASE WHEN {b} BETWEEN 0 AND 100 THEN {b} END", "range": _INT.format(f"replace({r}, 'KM', ' ')", _THREE), "odo": _INT.format(z, "\\b([0-9]{1,6})(?:\\.[0-9]+)?\\b")}


_PCT, _THREE = "([0-9]{1,3})\\s*%", "\\b([0-9]{1,3})\\b"


def _parse_sql() -> str:
    """CTEs up to ``parsed`` (case_id, odo, battery, range, notes as a list), field by field as the order of the fields demands."""
    like = lambda k: f"(abs(length({k}) - 3) <= 1 AND length({k}) >= 3 AND levenshtein(translate({k}, '012568', 'OIZSGB'), 'ODO') <= 1) OR (abs(length({k}) - 5) <= 1 AND levenshtein(translate({k}, '012568', 'OIZSGB'), 'TOTAL') <= 1)"
    rest = f"array_to_string(list_filter(string_split_regex(t, '\\s+'), lambda w: len(list_filter({_TOKENS.format('w')}, lambda k: {like('k')})) = 0), ' ')"
    values = _values_sql("t")
    out = f"""{_LINE_CTE}, q AS (SELECT *, {rest} AS rest FROM o), v AS (SELECT *, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, y1 - y0 AS h, {', '.join(f'{x} AS v_{f}' for f, x in values.items())}, {_values_sql('rest')['odo']} AS v_rest,
 length(t) <= 24 AND {_match_sql(LABELS['battery'])} AS is_battery, length(t) <= 24 AND {_match_sql(LABELS['range'])} AS is_range, length(t) <= 24 AND (contains(t, 'ODO') OR contains(t, 'TOTAL')) AS exact,
 length(t) <= 24 AND len(list_filter({_TOKENS.format('t')}, lambda k: {like('k')})) > 0 AS tolerant, {_match_sql(OTHER_LABELS)} AS other, regexp_matches(t, '^[0-9]{{1,3}}\\s*%$') AS pct,
 regexp_matches(t, '^[0-9O][0-9O.,]{{0,7}}\\s*[KLI][A-Z]{{0,2}}$') AS bare FROM q),
 a0 AS (SELECT case_id, min(i) FILTER (WHERE is_battery) AS a_battery, min(i) FILTER (WHERE is_range) AS a_range, min(i) FILTER (WHERE exact) AS ex, min(i) FILTER (WHERE tolerant) AS tol FROM v GROUP BY 1),
 a AS (SELECT case_id, a_battery, a_range, coalesce(ex, tol) AS a_odo, ex IS NULL AND tol IS NOT NULL AS misread FROM a0)"""
    used: list[str] = []
    free = "x.i IS DISTINCT FROM u.a_battery AND x.i IS DISTINCT FROM u.a_range AND x.i IS DISTINCT FROM u.a_odo"
    before = "a"
    for f in ("battery", "range", "odo"):
        own = "CASE WHEN u.misread THEN l.v_rest ELSE l.v_odo END" if f == "odo" else f"l.v_{f}"
        text = "CASE WHEN u.misread THEN l.rest ELSE l.t END" if f == "odo" else "l.t"
        gap, h = "greatest(x.x0 - l.x1, l.x0 - x.x1)", "greatest(l.h, 1)"
        close = f"x.h <= 5 * {h} AND ((x.cy > l.cy AND x.y0 - l.y1 <= 1.5 * {h} AND ((x.x0 < l.x1 AND x.x1 > l.x0) OR {gap} <= 2 * {h})) OR (x.y0 < l.y1 AND x.y1 > l.y0 AND {gap} <= 3 * {h}))"
        unused = "".join(f" AND x.i IS DISTINCT FROM u.u_{g}" for g in used)
        out += f""", n_{f} AS (SELECT u.case_id, arg_min({{'i': x.i, 'v': x.v_{f}, 't': x.t, 'how': CASE WHEN x.cy > l.y1 THEN 'nearest-below' ELSE 'nearest-beside' END}}, {{'d': (l.cx - x.cx) * (l.cx - x.cx) + (l.cy - x.cy) * (l.cy - x.cy), 'i': x.i}}) AS n
 FROM {before} u JOIN v l ON l.case_id = u.case_id AND l.i = u.a_{f} JOIN v x ON x.case_id = u.case_id WHERE {free}{unused} AND x.v_{f} IS NOT NULL AND {close} GROUP BY 1),
 p_{f} AS (SELECT u.*, coalesce({own}, n.v) AS p_{f}, CASE WHEN {own} IS NOT NULL THEN u.a_{f} ELSE n.i END AS pu_{f}, CASE WHEN u.a_{f} IS NULL THEN {'NULL' if f == 'odo' else f"'{f}: no anchor found'"}
  WHEN {own} IS NOT NULL THEN '{f}: taken from merged line "' || {text} || '"' WHEN n.i IS NOT NULL THEN '{f}: ' || n.how || ' match "' || n.t || '"' ELSE '{f}: anchor "' || {text} || '" found but no nearby numeric line' END AS note_{f}
  FROM (SELECT u.*, n FROM {before} u LEFT JOIN n_{f} ON n_{f}.case_id = u.case_id) u LEFT JOIN v l ON l.case_id = u.case_id AND l.i = u.a_{f})"""
        if f == "range":
            out += ", s_range AS (SELECT * EXCLUDE (n), p_range AS range_, pu_range AS u_range FROM p_range)"
        else:
            form = "x.pct" if f == "battery" else "x.bare AND NOT EXISTS (SELECT 1 FROM v b WHERE b.case_id = x.case_id AND b.i <> x.i AND b.other AND x.cy > b.cy AND x.y0 - b.y1 <= 1.5 * b.h)"
            one = "'battery: no BATTERY label; standalone percentage line \"'" if f == "battery" else "'odo: no label; lone \"value km\" line \"'"
            many = "'battery: multiple standalone % lines, ambiguous — skipped'" if f == "battery" else "'odo: multiple unlabeled \"value km\" lines, ambiguous — skipped'"
            out += f""", c_{f} AS (SELECT u.case_id, count(*) AS c, any_value(x.i) AS i, any_value(x.v_{f}) AS v, any_value(x.t) AS t FROM {before} u JOIN v x ON x.case_id = u.case_id WHERE u.a_{f} IS NULL AND {free}{unused} AND {form} GROUP BY 1),
 s_{f} AS (SELECT p.* EXCLUDE (n), coalesce(p_{f}, CASE WHEN c = 1 THEN c_{f}.v END) AS {f}_, coalesce(pu_{f}, CASE WHEN c = 1 AND c_{f}.v IS NOT NULL THEN c_{f}.i END) AS u_{f},
  CASE WHEN c > 1 THEN {many} WHEN c = 1 AND c_{f}.v IS NOT NULL THEN {one} || c_{f}.t || '"' END AS lone_{f} FROM p_{f} p LEFT JOIN c_{f} ON c_{f}.case_id = p.case_id)"""
        used.append(f)
        before = f"s_{f}"
    return out + """, parsed AS (SELECT s.case_id AS case_id, odo_ AS odo, battery_ AS battery, range_ AS range, list_filter([CASE WHEN misread THEN 'odo: anchor matched via OCR-tolerant pattern ("' || l.t || '")' END, note_battery, lone_battery, note_range, note_odo,
 CASE WHEN a_odo IS NULL THEN 'odo: no ODO anchor found — not falling back to largest number (speed trap)' END, lone_odo], lambda x: x IS NOT NULL) AS notes FROM s_odo s LEFT JOIN v l ON l.case_id = s.case_id AND l.i = s.a_odo)"""


_PARSE = _parse_sql()
_PRESENT = "list_filter([" + ", ".join(f"CASE WHEN {f} IS NOT NULL{{}} THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL)"
_LADDER = f"""{_PARSE}, ob AS (SELECT case_id // 8 AS photo, case_id % 8 AS ord, [{', '.join(f"'{p[0]}'" for p in _PLACES)}][case_id % 8 + 1] AS rung, [{', '.join(f"'{p[1]}'" for p in _PLACES)}][case_id % 8 + 1] AS engine,
 [{', '.join(f"'{p[2]}'" for p in _PLACES)}][case_id % 8 + 1] AS variant, odo, battery, range, notes FROM parsed),
 hd AS (SELECT *, row_number() OVER w = 1 AS head, {', '.join(f'count({f}) OVER (PARTITION BY photo ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS h_{f}' for f in FIELDS)} FROM ob WINDOW w AS (PARTITION BY photo ORDER BY ord)),
 ev AS (SELECT *, {_PRESENT.format(*(f' AND NOT h_{f}' for f in FIELDS))} AS accepted FROM hd WHERE head OR NOT (h_odo AND h_battery AND h_range)),
 rn AS (SELECT *, CASE WHEN rung = 'anchor-region' THEN accepted ELSE {_PRESENT.format('', '', '')} END AS produced FROM ev WHERE head OR rung <> 'anchor-region' OR len(accepted) > 0)"""
_SHOWN = "CAST({0} AS VARCHAR) || ' ← ' || engine || ' / ' || variant || ' / ' || rung"
_JSON = """'"{0}":{{"value":' || {0} || ',"engine":"' || engine || '","variant":"' || variant || '","stage":"' || rung || '","confidence":null}}'"""



def _fused_sql() -> str:
    cols = []
    for f in FIELDS:
        sane = {"odo": "{0} BETWEEN 12000 AND 13000", "battery": "{0} BETWEEN 0 AND 100", "range": "{0} BETWEEN 0 AND 250"}[f]
        a, b, ca, cb = f"a_{f}", f"b_{f}", f"ca_{f}", f"cb_{f}"
        sa, sb = f"({sane.format(a)})", f"({sane.format(b)})"
        rule = f"CASE WHEN {sa} <> {sb} THEN 'sanity check' WHEN {ca} <> {cb} THEN 'higher OCR confidence' WHEN e2 = 'paddle' THEN 'engine preference' ELSE 'primary engine fallback' END"
        first = f"CASE WHEN {sa} <> {sb} THEN {sa} WHEN {ca} <> {cb} THEN {ca} > {cb} ELSE e2 <> 'paddle' END"
        case = lambda none, one, same, other, a=a, b=b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {none} WHEN {a} IS NULL OR {b} IS NULL THEN {one} WHEN {a} = {b} THEN {same} ELSE {other} END"
        cols += [case("NULL", f"coalesce({a}, {b})", a, f"CASE WHEN {first} THEN {a} ELSE {b} END") + f" AS {f}_value", case("NULL", "'MEDIUM'", "'HIGH'", "'LOW'") + f" AS {f}_confidence",
                 case("NULL", f"CASE WHEN {a} IS NULL THEN e2 ELSE 'mlkit' END", "'both'", f"CASE WHEN {first} THEN 'mlkit' ELSE e2 END") + f" AS {f}_engine", case("NULL", "NULL", "NULL", rule) + f" AS {f}_tiebreak"]
    conf = ", ".join(f"max(confidence) FILTER (WHERE contains(regexp_replace(text, '[^0-9]', '', 'g'), CAST(p.{f} AS VARCHAR))) AS c_{f}" for f in FIELDS)
    return f"""{_PARSE}, z AS (SELECT p.case_id, p.odo, p.battery, p.range, {conf} FROM parsed p JOIN o USING (case_id) GROUP BY ALL),
 e AS (SELECT a.case_id // 8 AS photo, CASE WHEN a.case_id // 8 % 2 = 0 THEN 'paddle' ELSE 'other' END AS e2, {', '.join(f'a.{f} AS a_{f}, b.{f} AS b_{f}, a.c_{f} AS ca_{f}, b.c_{f} AS cb_{f}' for f in FIELDS)}
 FROM z a JOIN z b ON b.case_id = a.case_id + 1 WHERE a.case_id % 8 = 0) SELECT photo, {', '.join(cols)} FROM e"""


_GAUSS = lambda c, src: (f"SELECT p.vec_id, p.y, p.x, CAST(sum(w * q.v) AS BIGINT) // 16 AS v FROM ({src}) p, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) k(d, w), ({src}) q "  # noqa: E731
                         f"WHERE q.vec_id = p.vec_id AND q.{c} = greatest(0, least(7, p.{c} + d)) AND q.{'y' if c == 'x' else 'x'} = p.{'y' if c == 'x' else 'x'} GROUP BY 1, 2, 3")
_BACK = _window_sql(_MEAN, _MEAN, _window_sql(_MEAN, _MEAN, "SELECT * FROM p", 4), 4)

_RGB = "(SELECT vec_id, i, lum[3 * i + 1] r, lum[3 * i + 2] g, lum[3 * i + 3] b FROM g, range(21) t(i))"
_SCALED = lambda c, mean, dev: f"CAST(floor(({c} / 255.0::DOUBLE - {mean}::DOUBLE) / {dev}::DOUBLE * 1000 + 0.5) AS BIGINT)"
_TENSOR = lambda name: f"string_agg(CAST(x_{name} AS VARCHAR), ',' ORDER BY ch, i) AS {name}"
_SHOW = "'\"' || text || '\"'"

ORACLE = {
    "lines_changed": f"{_LINE_CTE} SELECT case_id, bool_or(text <> t) AS changed FROM o GROUP BY 1",
    "engine_panel": f"""{_LINE_CTE} SELECT case_id, 'mlkit (' || count(*) || ' lines)' || chr(10) || string_agg({_SHOW} || CASE WHEN confidence IS NULL THEN '' ELSE ' 0.' || lpad(CAST(CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS INTEGER) AS VARCHAR), 2, '0') END
 || chr(10) || '  ' || {_box_sql('x0', 'y0', 'x1', 'y1')}, chr(10) ORDER BY i) AS shown FROM o GROUP BY 1""",
    "debug_panel": f"""{_LINE_CTE} SELECT case_id, string_agg({_SHOW} || '  ' || {_box_sql('x0', 'y0', 'x1', 'y1')}, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Field sources:' || chr(10) || '• odo: 7 ← ' || case_id || chr(10) || chr(10)
 || 'Parser notes:' || chr(10) || '• odo: a' || chr(10) || '• range: b' AS shown FROM o GROUP BY 1""",
    "corner_order": f"""{_GRID}, c AS (SELECT vec_id, i, lum[2 * i + 1] x, lum[2 * i + 2] y FROM g, range(4) t(i)), s AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, i) k FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k IN (1, 4) ORDER BY x - y, i) j FROM s)
 SELECT vec_id, string_agg(x || ',' || y, ',' ORDER BY CASE WHEN k = 1 THEN 0 WHEN k = 4 THEN 2 WHEN j = 2 THEN 1 ELSE 3 END) AS corners FROM r GROUP BY 1""",
    "upper_median": f"{_GRID} SELECT vec_id, list_sort(lum)[len(lum) // 2 + 1] AS median FROM g",
    "luminance": f"{_GRID} SELECT vec_id, string_agg(CAST((299 * r + 587 * g + 114 * b) // 1000 AS VARCHAR), ',' ORDER BY i) AS lum FROM {_RGB} GROUP BY 1",
    "tensor_normalise": f"""{_GRID}, c AS (SELECT vec_id, i, 0 AS ch, {_SCALED('r', 0.5, 0.5)} AS x_symmetric, {_SCALED('r', 0.485, 0.229)} AS x_natural FROM {_RGB} UNION ALL SELECT vec_id, i, 1, {_SCALED('g', 0.5, 0.5)}, {_SCALED('g', 0.456, 0.224)} FROM {_RGB}
 UNION ALL SELECT vec_id, i, 2, {_SCALED('b', 0.5, 0.5)}, {_SCALED('b', 0.406, 0.225)} FROM {_RGB}) SELECT vec_id, {_TENSOR('symmetric')}, {_TENSOR('natural')} FROM c GROUP BY 1""",
    "ensemble_lines": _fused_sql(),
    "gaussian_blur": f"{_PIX}, gx AS ({_GAUSS('x', 'SELECT * FROM p')}) SELECT vec_id, {_LIST} AS blurred FROM ({_GAUSS('y', 'SELECT * FROM gx')}) GROUP BY 1",
    "illumination_flatten": f"""{_PIX}, f AS (SELECT p.vec_id, p.y, p.x, least(255, p.v * 128 // greatest(1, b.v)) AS f FROM p JOIN ({_BACK}) b USING (vec_id, y, x)), l AS (SELECT vec_id, min(f) lo, max(f) hi FROM f GROUP BY 1),
 s AS (SELECT f.vec_id, y, x, CASE WHEN hi <= lo THEN f ELSE (f - lo) * 255 // (hi - lo) END AS v FROM f JOIN l USING (vec_id)) SELECT vec_id, {_LIST} AS flat FROM s GROUP BY 1""",
    "connected_components": f"""WITH RECURSIVE {_PIX[5:]}, m AS (SELECT vec_id, y, x FROM p WHERE v > 127), r AS (SELECT vec_id, y * 8 + x AS a, y, x FROM m UNION SELECT r.vec_id, r.a, m.y, m.x FROM r JOIN m ON m.vec_id = r.vec_id AND abs(m.y - r.y) + abs(m.x - r.x) = 1),
 c AS (SELECT vec_id, a, min(y * 8 + x) AS c FROM r GROUP BY 1, 2), h AS (SELECT vec_id, c, max(a // 8) - min(a // 8) + 1 AS h FROM c GROUP BY 1, 2), k AS (SELECT vec_id, count(*) n, list_sort(list(h)) hs FROM h GROUP BY 1)
 SELECT g.vec_id AS vec_id, CAST(coalesce(n, 0) AS INTEGER) AS components, CAST(hs[n // 2 + 1] AS INTEGER) AS median_height FROM g LEFT JOIN k USING (vec_id)""",
    "dashboard_parse": f"{_PARSE} SELECT case_id, odo, battery, range, array_to_string(notes, '; ') AS notes FROM parsed",
    "ladder_provenance": f"{_LADDER} " + " UNION ALL ".join(f"SELECT photo, '{f}' AS field, {_SHOWN.format(f)} AS shown FROM rn WHERE list_contains(accepted, '{f}')" for f in FIELDS),
    "ladder_run": f"""{_LADDER}, k AS (SELECT case_id // 8 AS photo, case_id % 8 AS ord, count(*) AS n FROM o GROUP BY 1, 2),
 j AS (SELECT photo, '"fields":{{' || string_agg(x, ',' ORDER BY ord, n) || '}}' AS fields FROM ({' UNION ALL '.join(f"SELECT photo, ord, {n} AS n, {_JSON.format(f)} AS x FROM rn WHERE list_contains(accepted, '{f}')" for n, f in enumerate(FIELDS))}) GROUP BY 1)
 SELECT rn.photo AS photo, {', '.join(f"max({f}) FILTER (WHERE list_contains(accepted, '{f}')) AS {f}" for f in FIELDS)},
 string_agg(rung || ':' || engine || ':' || variant || ':' || array_to_string(produced, '|') || ':' || array_to_string(accepted, '|'), ';' ORDER BY rn.ord) AS events,
 CAST(sum(CASE WHEN rung = 'pass1' THEN n WHEN rung = 'anchor-region' THEN 0 ELSE n + 1 END) AS INTEGER) AS n_lines,
 CAST(sum(len(notes) + CASE WHEN rung IN ('pass1', 'anchor-region') THEN 0 ELSE len(accepted) END) AS INTEGER) AS n_notes,
 '{{"engines":[' || CASE WHEN bool_or(rung = 'pass1') THEN '"mlkit"' ELSE '' END || '],' || coalesce(any_value(fields), '"fields":{{}}') || ',"notes":[]}}' AS debugJson
 FROM rn JOIN k USING (photo, ord) LEFT JOIN j ON j.photo = rn.photo GROUP BY rn.photo""",
    "fill_empty_merge": f"""{_PARSE}, ln AS (SELECT case_id, string_agg(text, '|' ORDER BY i) AS t FROM o GROUP BY 1)
 SELECT a.case_id // 8 AS photo, {', '.join(f'coalesce(a.{f}, b.{f}) AS {f}' for f in FIELDS)}, la.t || '|— pass2 (high-res) —|' || lb.t AS lines,
 array_to_string(list_concat(a.notes, list_concat(list_filter([{', '.join(f"CASE WHEN a.{f} IS NULL AND b.{f} IS NOT NULL THEN '{f}: recovered by pass2 (high-res)' END" for f in FIELDS)}], lambda x: x IS NOT NULL),
 list_transform(b.notes, lambda x: 'pass2 (high-res): ' || x))), '; ') AS notes
 FROM parsed a JOIN parsed b ON b.case_id = a.case_id + 1 JOIN ln la ON la.case_id = a.case_id JOIN ln lb ON lb.case_id = b.case_id WHERE a.case_id % 8 = 0""",
    "text_normalize": f"{_LINE_CTE} SELECT case_id, i, t AS line, array_to_string({_TOKENS.format('t')}, '|') AS tokens, translate(t, '012568', 'OIZSGB') AS folded FROM o",
    "fuzzy_label_match": f"{_LINE_CTE} SELECT case_id, i, {_match_sql(('ODO', 'TOTAL'))} AS odo, {_match_sql(('BATTERY', 'BATT'))} AS battery, {_match_sql(('RANGE',))} AS range_ FROM o",
    "digit_repair": f"{_LINE_CTE} SELECT case_id, i, {_REPAIR.format('t')} AS repaired FROM o",
    "field_value_parsers": f"""{_LINE_CTE}, r AS (SELECT *, {_REPAIR.format('t')} AS r FROM o), z AS (SELECT *, {_ODO_TEXT} AS z0, coalesce({_INT.format('r', '([0-9]{1,3})\\s*%')}, {_INT.format('r', '\\b([0-9]{1,3})\\b')}) AS b FROM r)
 SELECT case_id, i, CASE WHEN b BETWEEN 0 AND 100 THEN b END AS battery, {_INT.format("replace(r, 'KM', ' ')", '\\b([0-9]{1,3})\\b')} AS range_,
 {_INT.format("CASE WHEN regexp_matches(z0, '^[0-9 .]+$') THEN replace(z0, ' ', '') ELSE z0 END", '\\b([0-9]{1,6})(?:\\.[0-9]+)?\\b')} AS odo,
 regexp_matches(t, '^[0-9]{{1,3}}\\s*%$') AS bare_percent, regexp_matches(t, '^[0-9O][0-9O.,]{{0,7}}\\s*[KLI][A-Z]{{0,2}}$') AS bare_odo FROM z""",
    "separator_normalize": f"""{_LINE_CTE}, s AS (SELECT *, regexp_extract(text, '[^.]*$') AS l, replace(text, '.', '') AS b FROM o)
 SELECT case_id, i, CASE WHEN NOT contains(text, '.') THEN text WHEN length(l) = 3 THEN b ELSE left(b, length(b) - length(l)) || '.' || l END AS shown FROM s""",
    "line_boxes": f"""{_LINE_CTE}, r AS (SELECT *, greatest(0, x0 - floor(0.3::DOUBLE * (x1 - x0))) l, greatest(0, y1) tp, least(360, x1 + floor(0.6::DOUBLE * (x1 - x0))) r, least(320, y1 + floor(2.4::DOUBLE * (y1 - y0))) b FROM o)
 SELECT case_id, i, {_box_sql('x0', 'y0', 'x1', 'y1')} AS box, {_box_sql('greatest(0, x0 - floor(0.06::DOUBLE * (x1 - x0)))', 'greatest(0, y0 - floor(0.12::DOUBLE * (y1 - y0)))',
 'least(360, x1 + floor(0.06::DOUBLE * (x1 - x0)))', 'least(320, y1 + floor(0.12::DOUBLE * (y1 - y0)))')} AS padded,
 CASE WHEN r - l >= 8 AND b - tp >= 8 THEN {_box_sql('l', 'tp', 'r', 'b')} END AS below FROM r""",
    "nearest_value": f"""{_LINE_CTE}, a AS (SELECT * FROM o WHERE text = 'RANGE' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY i) = 1),
 c AS (SELECT a.case_id, b.i, (a.x0 + a.x1) // 2 ax, (a.y0 + a.y1) // 2 ay, (b.x0 + b.x1) // 2 bx, (b.y0 + b.y1) // 2 cy, greatest(a.y1 - a.y0, 1) h, b.y1 - b.y0 lh, b.x0 < a.x1 AND b.x1 > a.x0 ov,
  greatest(b.x0 - a.x1, a.x0 - b.x1) gap, b.y0 - a.y1 dy, b.y0 < a.y1 AND b.y1 > a.y0 beside, a.y1 abot FROM a JOIN o b ON a.case_id = b.case_id AND a.i <> b.i),
 n AS (SELECT *, CASE WHEN cy > abot THEN 'nearest-below' ELSE 'nearest-beside' END how FROM c WHERE lh <= 5 * h AND ((cy > ay AND dy <= 1.5 * h AND (ov OR gap <= 2 * h)) OR (beside AND gap <= 3 * h))
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY (ax - bx) * (ax - bx) + (ay - cy) * (ay - cy), i) = 1)
 SELECT a.case_id AS case_id, n.i AS nearest, how FROM a LEFT JOIN n ON a.case_id = n.case_id""",
    "line_confidence": f"{_LINE_CTE} SELECT case_id, max(CAST(confidence AS DOUBLE)) FILTER (WHERE contains(regexp_replace(text, '[^0-9]', '', 'g'), CAST(case_id % 100 AS VARCHAR))) AS confidence FROM o GROUP BY 1",
    "reading_order": f"{_LINE_CTE} SELECT case_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY y0, x0, i) AS order_ FROM o GROUP BY 1",
    "csv_cells": "SELECT coalesce(filename, '') AS c0, coalesce(CAST(odo AS VARCHAR), '') AS c1, coalesce(CAST(battery AS VARCHAR), '') AS c2, coalesce(CAST(range AS VARCHAR), '') AS c3, 4 AS n FROM gt_entries",
    "quad_metrics": "WITH q AS (SELECT vec_id, " + ", ".join(f"{c} x{i}, {r} y{i}" for i, (c, r) in enumerate(zip(_C, _R))) + f""" FROM embeddings), m AS (SELECT vec_id, {_AREA} AS area, {_BOX} AS box_area, x0, x1, x2, x3, y0, y1, y2, y3,
 ({_SIDE(0, 1)} + {_SIDE(3, 2)}) / 2 AS w, ({_SIDE(1, 2)} + {_SIDE(0, 3)}) / 2 AS h FROM q)
 SELECT vec_id, area, box_area, round(w, 6) AS width, round(h, 6) AS height, round(greatest({_FLAT(0, 1)}, {_FLAT(3, 2)}, {_STEEP(0, 3)}, {_STEEP(1, 2)}), 6) AS skew, box_area <= 0 OR w < 2 OR h < 2 OR area < 0.6::DOUBLE * box_area AS degenerate FROM m""",
    "ctc_decode": """WITH t AS (SELECT vec_id, k, embedding[k * 8 + 1 : k * 8 + 8] s FROM embeddings, range(8) r(k)), b AS (SELECT vec_id, k, list_position(s, list_max(s)) - 1 c, CAST(list_max(s) AS DOUBLE) p FROM t),
 l AS (SELECT *, lag(c, 1, -1) OVER (PARTITION BY vec_id ORDER BY k) w FROM b)
 SELECT vec_id, coalesce(string_agg(['', '1', '2', '3', '4', '5', '6', ' '][c + 1], '' ORDER BY k) FILTER (WHERE c <> 0 AND c <> w), '') AS text,
 round(coalesce(sum(p ORDER BY k) FILTER (WHERE c <> 0 AND c <> w) / count(*) FILTER (WHERE c <> 0 AND c <> w), 0), 6) AS confidence FROM l GROUP BY vec_id""",
    "sharpness_gate": f"{_PIX} SELECT vec_id, round(score, 3) AS score, score < 60 AS blurred FROM ({_SCORE})",
    "laplacian_variance": f"{_PIX} SELECT vec_id, round(score, 3) AS score FROM ({_SCORE})",
    "box_blur": f"{_PIX} SELECT vec_id, {_LIST} AS blurred FROM ({_BLUR}) GROUP BY 1",
    "adaptive_threshold": f"{_PIX} SELECT vec_id, string_agg(CASE WHEN p.v > b.v + 5 THEN '1' ELSE '0' END, ',' ORDER BY y, x) AS mask FROM p JOIN ({_BLUR}) b USING (vec_id, y, x) GROUP BY 1",
    "morph_close": f"{_PIX} SELECT vec_id, {_LIST} AS mask FROM ({_CLOSE}) GROUP BY 1",
    "otsu": f"""{_PIX}, h AS (SELECT vec_id, t, count(*) FILTER (WHERE v <= t) wb, coalesce(sum(v) FILTER (WHERE v <= t), 0) sb, sum(v) s FROM p, range(256) r(t) GROUP BY 1, 2),
 b AS (SELECT vec_id, t, CAST(wb AS DOUBLE) * (64 - wb) * pow(sb / CAST(wb AS DOUBLE) - (s - sb) / CAST(64 - wb AS DOUBLE), 2) f FROM h WHERE wb > 0 AND wb < 64)
 SELECT g.vec_id AS vec_id, CAST(coalesce(arg_max(t, (f, -t)), 0) AS INTEGER) AS threshold FROM g LEFT JOIN b ON g.vec_id = b.vec_id GROUP BY 1""",
}
