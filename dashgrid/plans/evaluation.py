"""Queries of the storage and evaluation layers over readings, batch rows and entries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_escape
from ..operators import fuse, readings as R, report, stats as A, truth as T
from ..schemas import FIELDS, MODES, RUNGS, TIEBREAKS, engines_of, mode_or_default
from ..session import table
from ..sources.files import display_name, file_ending, image_hashes
from ..sources.images import take_images

_READING = "id, vehicleId, timestamp, odoKm, batteryPct, rangeKm, eventType, userEdited, ocrOdo, ocrBattery, ocrRange, imagePath, imageHash"


def _r(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "readings")


def _b(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "batch_rows")


def _matched(s: SparkSession, d: str) -> DataFrame:
    return T.match_truth(_b(s, d), T.truth_by_hash(_r(s, d)), T.truth_by_name(_r(s, d)))


def _flat(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(F.col(f"entry.{c}").alias(c) for c in ("filename", *FIELDS, "corrected")))


def _last_odo(s: SparkSession, d: str) -> DataFrame:
    """The highest odometer of each vehicle among values the field can hold."""
    return _r(s, d).where("odoKm between 0 and 999999").groupBy("vehicleId").agg(F.max("odoKm").alias("last_odo"))


def backfill_update(s: SparkSession, d: str) -> DataFrame:
    """Readings without a hash take that of the batch rows of the same photo (vehicle and moment)."""
    known = _b(s, d).where("imageHash is not null").groupBy("vehicleId", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', capturedAt)").alias("timestamp")).agg(F.min("imageHash").alias("hash"))
    updates = R.missing_hash(_r(s, d)).join(known, ["vehicleId", "timestamp"]).select("id", "hash")
    return R.set_hashes(_r(s, d), updates).select("id", "imageHash")


def append_readings(s: SparkSession, d: str) -> DataFrame:
    """All readings appended once more: the new id of each row."""
    r = _r(s, d)
    return R.append(r, r.withColumn("of", F.col("id")), "of").select("of", "id", "timestamp", "odoKm")


def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    """Both snapshots hold the odometer as bigint: a misread value can be the largest int, which has no next one."""
    r = _r(s, d).withColumn("odoKm", F.col("odoKm").cast("bigint"))
    new = r.where("id % 7 <> 0").withColumn("odoKm", F.when(F.col("userEdited"), F.col("odoKm") + 1).otherwise(F.col("odoKm")))
    return R.snapshot_diff(r.where("id % 11 <> 0"), new, "id", ["odoKm", "batteryPct", "rangeKm"])


def image_mode_cross(s: SparkSession, d: str) -> DataFrame:
    """Every image hash meets the three modes once; the modes are a constant, so this is no join of two tables."""
    images = _b(s, d).select("imageHash").where("imageHash is not null").distinct()
    return images.select("imageHash", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))


def user_edited_flag(s: SparkSession, d: str) -> DataFrame:
    return _r(s, d).select("id", R.is_edited().alias("edited"))


def sanity_warnings(s: SparkSession, d: str) -> DataFrame:
    r = _r(s, d).join(_last_odo(s, d), "vehicleId", "left")
    return r.select("id", F.array_join(R.warnings(F.col("last_odo")), ",").alias("warnings"))


def rung_ladder(s: SparkSession, d: str) -> DataFrame:
    """The first value of each photo's fields in the order of its runs."""
    obs = _b(s, d).where("imageHash is not null").select("imageHash", F.col("rowId").alias("rung_no"), *FIELDS)
    return fuse.ladder(obs, ["imageHash"])


def ladder_events(s: SparkSession, d: str) -> DataFrame:
    """Per run of a photo: fields produced, accepted (new) and discarded."""
    obs = _b(s, d).where("imageHash is not null").select("imageHash", F.col("rowId").alias("rung_no"), *FIELDS)
    e = fuse.ladder_events(obs, ["imageHash"])
    return e.select("rung_no", *(F.array_join(F.array_sort(c), "|").alias(c) for c in ("produced", "accepted", "discarded")))


def ensemble_merge(s: SparkSession, d: str) -> DataFrame:
    """Both single-engine runs of a photo fused, field by field; each engine's last run counts."""
    b = _b(s, d).where("imageHash is not null and mode in ('ML_KIT', 'PADDLE')")
    last = lambda mode: F.max(F.when(F.col("mode") == mode, F.struct("rowId", *FIELDS)))
    g = b.groupBy("vehicleId", "imageHash").agg(last("ML_KIT").alias("m"), last("PADDLE").alias("p"))
    g = g.join(_last_odo(s, d), "vehicleId", "left")
    lines = F.array().cast("array<struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>>")
    side = lambda c, name: F.struct(F.lit(name).alias("engine"), *(F.col(f"{c}.{f}").alias(f) for f in FIELDS), lines.alias("lines"))
    out = fuse.ensemble(g.withColumns({"first": side("m", "mlkit"), "second": side("p", "paddle")}))
    return out.select("vehicleId", "imageHash", *(F.col(f"{f}_outcome.{c}").alias(f"{f}_{c}") for f in FIELDS for c in ("value", "confidence", "engine", "note", "tiebreak")))


def batch_csv_rows(s: SparkSession, d: str) -> DataFrame:
    """The 31 cells of each batch row, joined to one line."""
    return _b(s, d).select("rowId", report.csv_line().alias("line"))


def provenance_json(s: SparkSession, d: str) -> DataFrame:
    """The debug JSON of every batch row: engines of its mode, provenance, the ensemble's notes."""
    outcome = lambda f: F.try_element_at("ensembleOutcomes", F.lit(f))["note"]
    return _b(s, d).select("rowId", fuse.provenance_json(F.col("provenance"), engines_of(F.col("mode")), F.array_compact(F.array(*map(outcome, FIELDS)))).alias("json"))


def truth_csv(s: SparkSession, d: str) -> DataFrame:
    """Entries written as CSV lines and read again: the last line of a name wins, in the order of the values."""
    e = table(s, d, "gt_entries").where("filename is not null")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(",", csv_escape(F.col("filename")), *(text(f) for f in FIELDS))
    rank = F.concat(*(F.lpad(F.coalesce(F.col(f), F.lit(-1)) + 1, 11, "0") for f in FIELDS))
    return _flat(T.parse_truth_csv(e.select(line.alias("value"), rank.alias("line_no"))), "name").drop("corrected")


def headline(s: SparkSession, d: str) -> DataFrame:
    label = T.truth_counts(T.truth_by_hash(_r(s, d)), T.truth_by_name(_r(s, d))).select("label")
    return T.headline(T.match_summary(_matched(s, d)).join(label), F.col("label"))  # one row each


def provenance_display(s: SparkSession, d: str) -> DataFrame:
    p = _b(s, d).select("rowId", F.explode("provenance").alias("field", "p"))
    return p.select("rowId", "field", fuse.provenance_text(F.col("p")).alias("shown"))


def engine_retry_order(s: SparkSession, d: str) -> DataFrame:
    """Each rung event's place when retries take paddle first and keep the order otherwise."""
    e = _b(s, d).select("rowId", F.posexplode("rungEvents").alias("pos", "e"))
    order = F.array_sort(F.collect_list(F.struct((F.col("e.engine") != "paddle").alias("later"), "pos", F.col("e.engine").alias("engine"))))
    return e.groupBy("rowId").agg(F.array_join(F.transform(order, lambda x: x["engine"]), ",").alias("engines"))


def missing_fields(s: SparkSession, d: str) -> DataFrame:
    return _b(s, d).select("rowId", F.array_join(fuse.fields_present(*(F.col(f) for f in FIELDS)), "|").alias("present"),
                           (F.col("odo").isNull() | F.col("battery").isNull() | F.col("range").isNull()).alias("is_missing"))


def file_names(s: SparkSession, d: str) -> DataFrame:
    """Name and ending of every reading's photo."""
    name = display_name(F.col("imagePath"))
    return _r(s, d).where("imagePath is not null").select("id", name.alias("name"), file_ending(name).alias("ending"))


def content_hash(s: SparkSession, d: str) -> DataFrame:
    """SHA-256 of bytes, here those of the photos' paths, as the photos aren't there."""
    files = _r(s, d).select(F.col("id").cast("string").alias("path"), F.col("eventType").alias("name"), F.encode("imagePath", "UTF-8").alias("content"))
    return image_hashes(files).select("path", "hash")


def image_limit(s: SparkSession, d: str) -> DataFrame:
    """The photos taken at once."""
    return take_images(_r(s, d).where("imagePath is not null").select(F.col("imagePath").alias("path")).distinct())


def mode_default(s: SparkSession, d: str) -> DataFrame:
    """The mode in force for settings that are spelled wrong or missing in part of the rows."""
    stored = F.when(F.col("rowId") % 5 == 0, F.lower("mode")).when(F.col("rowId") % 7 != 0, F.col("mode"))
    return _b(s, d).select("rowId", mode_or_default(stored).alias("mode"))


QUERIES = {
    "file_names": file_names, "content_hash": content_hash, "image_limit": image_limit, "mode_default": mode_default,
    "scan_newest": lambda s, d: R.newest_first(_r(s, d)),
    "point_lookup": lambda s, d: R.by_id(_r(s, d), 5),
    "user_edited_scan": lambda s, d: R.edited(_r(s, d)),
    "missing_hash_scan": lambda s, d: R.missing_hash(_r(s, d)),
    "max_odo": lambda s, d: R.max_odo(_r(s, d)),
    "append_readings": append_readings,
    "backfill_update": backfill_update,
    "migrate_add_columns": lambda s, d: R.migrate(_r(s, d), {"debugJson": "string", "synced": "boolean"}).select("id", "debugJson", "synced"),
    "snapshot_diff": snapshot_diff,
    "row_rendering": lambda s, d: _r(s, d).select("id", R.row_text().alias("shown")),
    "time_rendering": lambda s, d: _r(s, d).select("id", R.time_text().alias("shown")),
    "user_edited_flag": user_edited_flag,
    "sanity_warnings": sanity_warnings,
    "truth_first_per_hash": lambda s, d: _flat(T.truth_by_hash(_r(s, d)), "hash"),
    "truth_first_per_name": lambda s, d: _flat(T.truth_by_name(_r(s, d)), "name"),
    "truth_entries_by_name": lambda s, d: _flat(T.entries_by_name(table(s, d, "gt_entries"), [F.desc_nulls_last(c) for c in ("corrected", *FIELDS, "filename")]), "name"),
    "truth_csv_parse": truth_csv,
    "match_resolve": lambda s, d: _matched(s, d).select("rowId", *(F.col(f"truth.{c}").alias(c) for c in (*FIELDS, "corrected")), "by_hash"),
    "match_summary": lambda s, d: T.match_summary(_matched(s, d)),
    "match_headline": headline,
    "truth_counts": lambda s, d: T.truth_counts(T.truth_by_hash(_r(s, d)), T.truth_by_name(_r(s, d))),
    "truth_to_csv": lambda s, d: T.truth_csv_lines(table(s, d, "gt_entries")),
    "save_gate": lambda s, d: _r(s, d).select("id", R.save_gate().alias("g")).select("id", "g.battery", "g.refused"),
    "detail_rendering": lambda s, d: _r(s, d).select("id", R.detail_text().alias("shown")),
    "mode_engines": lambda s, d: _b(s, d).select("rowId", F.array_join(engines_of(F.col("mode")), ",").alias("engines")),
    "image_count": lambda s, d: _b(s, d).agg(F.countDistinct("imageName").alias("images"), F.count(F.lit(1)).alias("runs")),
    "image_mode_cross": image_mode_cross,
    "fill_rate": lambda s, d: A.fill_rate(_b(s, d)),
    "ratio_format": lambda s, d: A.ratios(A.fill_rate(_b(s, d))),
    "rung_table": lambda s, d: A.rung_table(_b(s, d)),
    "dead_rungs": lambda s, d: A.rung_table(_b(s, d)).where("is_dead or ran = 0").select("rung", "ran"),
    "engine_variant_matrix": lambda s, d: A.engine_variant(_b(s, d)),
    "engine_variant_pivot": lambda s, d: A.engine_variant_pivot(_b(s, d)),
    "merge_outcomes": lambda s, d: A.merge_outcomes(_b(s, d)),
    "tiebreak_counts": lambda s, d: A.tiebreak_counts(_b(s, d)),
    "latency_avg": lambda s, d: A.latency(_b(s, d)),
    "accuracy": lambda s, d: A.accuracy(_matched(s, d)),
    "discarded_fields": lambda s, d: A.unused_fields(_b(s, d)),
    "missing_fields": missing_fields,
    "engine_retry_order": engine_retry_order,
    "ensemble_merge": ensemble_merge,
    "fill_empty_ladder": rung_ladder,
    "ladder_events": ladder_events,
    "batch_csv_rows": batch_csv_rows,
    "provenance_json": provenance_json,
    "provenance_display": provenance_display,
}

_NAME = "regexp_replace(lower(regexp_extract({}, '[^/]*$')), '^\\s+|\\s+$', '', 'g')"
_ENTRY = "coalesce(nullif(regexp_extract(imagePath, '[^/]*$'), ''), 'reading_' || id) AS filename, odoKm AS odo, batteryPct AS battery, rangeKm AS range, coalesce(userEdited, false) AS corrected"
_BY_HASH = f"""SELECT imageHash AS hash, {_ENTRY} FROM readings WHERE imageHash IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY imageHash ORDER BY timestamp DESC NULLS LAST, id) = 1"""
_BY_NAME = f"""SELECT n AS name, {_ENTRY} FROM (SELECT *, CASE WHEN regexp_extract(imagePath, '[^/]*$') <> '' THEN {_NAME.format('imagePath')} END n FROM readings)
 WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n ORDER BY timestamp DESC NULLS LAST, id) = 1"""
_MATCH = f"""WITH h AS ({_BY_HASH}), n AS ({_BY_NAME}), m AS (SELECT b.*, h.hash IS NOT NULL AS by_hash, h.hash IS NOT NULL OR n.name IS NOT NULL AS hit,
 {', '.join(f'CASE WHEN h.hash IS NOT NULL THEN h.{c} ELSE n.{c} END AS t_{c}' for c in (*FIELDS, 'corrected'))}
 FROM batch_rows b LEFT JOIN h ON b.imageHash = h.hash LEFT JOIN n ON {_NAME.format('b.imageName')} = n.name)"""
_EVENTS = "(SELECT rowId, unnest(rungEvents) e FROM batch_rows)"
_RUNG = f"""SELECT coalesce(k.rung, g.rung) AS rung, coalesce(ran, 0) AS ran, coalesce(produced, 0) AS produced, coalesce(accepted, 0) AS accepted,
 coalesce(ran, 0) > 0 AND coalesce(accepted, 0) = 0 AS is_dead
 FROM (VALUES {', '.join(f"('{r}')" for r in RUNGS)}) k(rung) FULL JOIN (SELECT e.rung AS rung, count(*) ran, CAST(sum(len(e.produced)) AS BIGINT) produced, CAST(sum(len(e.accepted)) AS BIGINT) accepted
 FROM {_EVENTS} GROUP BY 1) g ON k.rung = g.rung"""
_EV = f"SELECT e.engine AS engine, e.variant AS variant, CAST(sum(len(e.accepted)) AS BIGINT) AS accepted FROM {_EVENTS} WHERE len(e.accepted) > 0 GROUP BY 1, 2"
_OUT = "(SELECT x.key AS field, x.value.confidence AS confidence, x.value.tiebreak AS tiebreak FROM (SELECT unnest(map_entries(ensembleOutcomes)) x FROM batch_rows WHERE mode = 'BOTH') WHERE x.value.confidence IS NOT NULL)"
_LAST = "(SELECT vehicleId, max(odoKm) AS last_odo FROM readings WHERE odoKm BETWEEN 0 AND 999999 GROUP BY 1)"
_FILL = " UNION ALL ".join(f"SELECT mode, '{f}' AS field, count({f}) AS filled, count(*) AS total FROM batch_rows GROUP BY mode" for f in FIELDS)


def _csv_sql() -> str:
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    esc = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
    cells = [esc(text("imageName")), text("imageHash"), text("mode")]
    for f in FIELDS:
        cells += [text(f), *(text(f"provenance['{f}'].{c}") for c in ("engine", "variant", "stage", "confidence"))]
    ran = "array_to_string(list_transform(rungEvents, lambda e: e.rung), ';')"
    won = "array_to_string(list_transform(list_filter(rungEvents, lambda e: len(e.accepted) > 0), lambda e: e.rung || ':' || array_to_string(list_sort(e.accepted), '|')), ';')"
    cells += [text("totalMillis"), text("pass1Millis"), text("ladderMillis"), esc(text(ran)), esc(text(won))]
    cells += ["CASE WHEN groundTruth IS NULL THEN '0' ELSE '1' END", "CASE WHEN groundTruth IS NULL THEN '' WHEN groundTruth.corrected THEN '1' ELSE '0' END"]
    for f in FIELDS:
        cells += [text(f"groundTruth.{f}"), f"CASE WHEN groundTruth.{f} IS NULL THEN '' WHEN {f} = groundTruth.{f} THEN '1' ELSE '0' END"]
    return "SELECT rowId, " + " || ',' || ".join(f"({c})" for c in cells) + " AS line FROM batch_rows"


def _merge_sql() -> str:
    cols = []
    for f in FIELDS:
        a, b = f"m.{f}", f"p.{f}"
        sane = {"odo": "({0} >= 0 AND (last_odo IS NULL OR {0} BETWEEN last_odo AND CAST(last_odo AS BIGINT) + 1000))", "battery": "({0} BETWEEN 0 AND 100)", "range": "({0} BETWEEN 0 AND 250)"}[f]
        sa, sb = sane.format(a), sane.format(b)
        rule = f"CASE WHEN {sa} <> {sb} THEN 'sanity check' ELSE 'engine preference' END"
        first = f"({sa} AND NOT {sb})"
        won, who = f"CASE WHEN {first} THEN {a} ELSE {b} END", f"CASE WHEN {first} THEN 'mlkit' ELSE 'paddle' END"
        case = lambda none, one, same, other, a=a, b=b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {none} WHEN {a} IS NULL OR {b} IS NULL THEN {one} WHEN {a} = {b} THEN {same} ELSE {other} END"
        single = f"CASE WHEN {a} IS NULL THEN 'paddle' ELSE 'mlkit' END"
        cols += [
            case("NULL", f"coalesce({a}, {b})", a, won) + f" AS {f}_value", case("NULL", "'MEDIUM'", "'HIGH'", "'LOW'") + f" AS {f}_confidence", case("NULL", single, "'both'", who) + f" AS {f}_engine",
            case("NULL", f"'{f}: only ' || {single} || ' found ' || coalesce({a}, {b})", f"'{f}: mlkit and paddle agree on ' || {a}",
                 f"'{f}: disagreement — mlkit=' || {a} || ' vs paddle=' || {b} || '; took ' || {won} || ' from ' || {who} || ' (' || {rule} || ')'") + f" AS {f}_note",
            case("NULL", "NULL", "NULL", rule) + f" AS {f}_tiebreak",
        ]
    last = lambda m: f"arg_max(struct_pack(odo := odo, battery := battery, range := range), rowId) FILTER (WHERE mode = '{m}')"
    return f"""WITH g AS (SELECT vehicleId, imageHash, {last('ML_KIT')} m, {last('PADDLE')} p FROM batch_rows WHERE imageHash IS NOT NULL AND mode IN ('ML_KIT', 'PADDLE') GROUP BY 1, 2)
 SELECT g.vehicleId AS vehicleId, imageHash, {', '.join(cols)} FROM g LEFT JOIN {_LAST} l ON g.vehicleId = l.vehicleId"""


_PRESENT = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '|')"

ORACLE = {
    "file_names": "SELECT id, regexp_extract(imagePath, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(imagePath, '[^/]*$'), '\\.([^.]+)$', 1)) AS ending FROM readings WHERE imagePath IS NOT NULL",
    "content_hash": "SELECT CAST(id AS VARCHAR) AS path, sha256(imagePath) AS hash FROM readings",
    "image_limit": "SELECT DISTINCT imagePath AS path FROM readings WHERE imagePath IS NOT NULL ORDER BY path LIMIT 100",
    "mode_default": "SELECT rowId, CASE WHEN rowId % 5 = 0 OR rowId % 7 = 0 THEN 'BOTH' ELSE mode END AS mode FROM batch_rows",
    "scan_newest": f"SELECT {_READING} FROM readings ORDER BY timestamp DESC",
    "point_lookup": f"SELECT {_READING} FROM readings WHERE id = 5",
    "user_edited_scan": f"SELECT {_READING} FROM readings WHERE userEdited ORDER BY timestamp DESC",
    "missing_hash_scan": f"SELECT {_READING} FROM readings WHERE imageHash IS NULL AND imagePath IS NOT NULL",
    "max_odo": "SELECT max(odoKm) AS max_odo FROM readings",
    "append_readings": "SELECT id AS of, (SELECT max(id) FROM readings) + row_number() OVER (ORDER BY timestamp NULLS FIRST, id) AS id, timestamp, odoKm FROM readings",
    "backfill_update": """WITH k AS (SELECT vehicleId, date_diff('ms', TIMESTAMP '1970-01-01', capturedAt) ts, min(imageHash) h FROM batch_rows WHERE imageHash IS NOT NULL GROUP BY 1, 2)
 SELECT id, CASE WHEN imageHash IS NULL AND imagePath IS NOT NULL THEN h ELSE imageHash END AS imageHash FROM readings r LEFT JOIN k ON r.vehicleId = k.vehicleId AND r.timestamp = k.ts""",
    "migrate_add_columns": "SELECT id, CAST(NULL AS VARCHAR) AS debugJson, CAST(NULL AS BOOLEAN) AS synced FROM readings",
    "snapshot_diff": """WITH a AS (SELECT * FROM readings WHERE id % 11 <> 0), b AS (SELECT id, CASE WHEN userEdited THEN odoKm + 1 ELSE odoKm END odoKm, batteryPct, rangeKm FROM readings WHERE id % 7 <> 0)
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id
 WHERE a.id IS NULL OR b.id IS NULL OR a.odoKm IS DISTINCT FROM b.odoKm OR a.batteryPct IS DISTINCT FROM b.batteryPct OR a.rangeKm IS DISTINCT FROM b.rangeKm""",
    "row_rendering": "SELECT id, 'Odo: ' || coalesce(CAST(odoKm AS VARCHAR), '–') || ' km · Battery: ' || coalesce(CAST(batteryPct AS VARCHAR), '–') || '% · Range: ' || coalesce(CAST(rangeKm AS VARCHAR), '–') AS shown FROM readings",
    "time_rendering": "SELECT id, strftime(epoch_ms(timestamp), '%b %-d, %Y %-I:%M %p') AS shown FROM readings",
    "user_edited_flag": "SELECT id, odoKm IS DISTINCT FROM ocrOdo OR batteryPct IS DISTINCT FROM ocrBattery OR rangeKm IS DISTINCT FROM ocrRange AS edited FROM readings",
    "sanity_warnings": f"""SELECT id, array_to_string(list_filter([CASE WHEN NOT batteryPct BETWEEN 0 AND 100 THEN 'battery' END, CASE WHEN odoKm < last_odo THEN 'odo_lower' WHEN odoKm > CAST(last_odo AS BIGINT) + 1000 THEN 'odo_jump' END,
 CASE WHEN rangeKm > 250 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS warnings FROM readings r LEFT JOIN {_LAST} l ON r.vehicleId = l.vehicleId""",
    "truth_first_per_hash": _BY_HASH,
    "truth_first_per_name": _BY_NAME,
    "truth_entries_by_name": f"""SELECT n AS name, filename, odo, battery, range, corrected FROM (SELECT *, nullif({_NAME.format('filename')}, '') n FROM gt_entries) WHERE n IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY n ORDER BY corrected DESC NULLS LAST, odo DESC NULLS LAST, battery DESC NULLS LAST, range DESC NULLS LAST, filename DESC NULLS LAST) = 1""",
    "truth_csv_parse": f"""SELECT n AS name, regexp_replace(filename, '^\\s+|\\s+$', '', 'g') AS filename, odo, battery, range FROM (SELECT *, nullif({_NAME.format('filename')}, '') n FROM gt_entries) WHERE n IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY n ORDER BY coalesce(odo, -1) DESC, coalesce(battery, -1) DESC, coalesce(range, -1) DESC, filename DESC) = 1""",
    "match_resolve": f"{_MATCH} SELECT rowId, {', '.join(f't_{c} AS {c}' for c in (*FIELDS, 'corrected'))}, by_hash FROM m",
    "match_summary": f"""{_MATCH}, l AS (SELECT imageName, arg_max(by_hash, rowId) FILTER (WHERE hit) h, arg_max(t_corrected, rowId) FILTER (WHERE hit) c FROM m WHERE imageName IS NOT NULL GROUP BY 1)
 SELECT count(*) AS images, count(h) AS matched, count(*) FILTER (WHERE h) AS by_hash, count(*) FILTER (WHERE NOT h) AS by_name, count(*) FILTER (WHERE c) AS corrected, count(*) FILTER (WHERE NOT c) AS confirmed FROM l""",
    "match_headline": f"""{_MATCH}, l AS (SELECT imageName, arg_max(by_hash, rowId) FILTER (WHERE hit) h, arg_max(t_corrected, rowId) FILTER (WHERE hit) c FROM m WHERE imageName IS NOT NULL GROUP BY 1)
 SELECT 'Ground truth: ' || count(h) || ' of ' || count(*) || ' images matched (source: saved readings — ' || (SELECT count(*) FILTER (WHERE corrected) || ' corrected, ' || count(*) FILTER (WHERE NOT corrected) FROM h)
 || ' confirmed-as-is) — ' || count(*) FILTER (WHERE c) || ' corrected, ' || count(*) FILTER (WHERE NOT c) || ' confirmed-as-is' AS headline FROM l""",
    "truth_counts": f"""SELECT by_hash, by_name, corrected, confirmed, 'saved readings — ' || corrected || ' corrected, ' || confirmed || ' confirmed-as-is' AS label
 FROM (SELECT count(*) by_hash, count(*) FILTER (WHERE corrected) corrected, count(*) FILTER (WHERE NOT corrected) confirmed FROM ({_BY_HASH})), (SELECT count(*) by_name FROM ({_BY_NAME}))""",
    "truth_to_csv": "SELECT CASE WHEN regexp_matches(filename, '[,\"\\n\\r]') THEN '\"' || replace(filename, '\"', '\"\"') || '\"' ELSE coalesce(filename, '') END || " + " || ".join(f"',' || coalesce(CAST({f} AS VARCHAR), '')" for f in FIELDS) + " AS value FROM gt_entries",
    "save_gate": "SELECT id, CASE WHEN batteryPct BETWEEN 0 AND 100 THEN batteryPct END AS battery, coalesce(batteryPct < 0 OR batteryPct > 100, false) AS refused FROM readings",
    "detail_rendering": "SELECT id, concat_ws(chr(10), strftime(epoch_ms(timestamp), '%b %-d, %Y %-I:%M %p'), eventType, 'Odometer: ' || coalesce(CAST(odoKm AS VARCHAR), '–') || ' km', 'Battery: ' || coalesce(CAST(batteryPct AS VARCHAR), '–') || '%', 'Range: ' || coalesce(CAST(rangeKm AS VARCHAR), '–') || ' km', "
                        "'Raw OCR values — odo: ' || coalesce(CAST(ocrOdo AS VARCHAR), '–') || ', battery: ' || coalesce(CAST(ocrBattery AS VARCHAR), '–') || ', range: ' || coalesce(CAST(ocrRange AS VARCHAR), '–'), CASE WHEN userEdited THEN 'edited' END) AS shown FROM readings",
    "mode_engines": "SELECT rowId, CASE mode WHEN 'ML_KIT' THEN 'mlkit' WHEN 'PADDLE' THEN 'paddle' ELSE 'mlkit,paddle' END AS engines FROM batch_rows",
    "provenance_json": """SELECT rowId, '{"engines":[' || CASE mode WHEN 'ML_KIT' THEN '"mlkit"' WHEN 'PADDLE' THEN '"paddle"' ELSE '"mlkit","paddle"' END || '],"fields":{' || coalesce(array_to_string(list_transform(map_entries(provenance), lambda e:
 to_json(e.key) || ':{"value":' || coalesce(CAST(e.value.value AS VARCHAR), 'null') || ',"engine":' || to_json(e.value.engine) || ',"variant":' || to_json(e.value.variant) || ',"stage":' || to_json(e.value.stage) || ',"confidence":' || coalesce(to_json(e.value.confidence), 'null') || '}'), ','), '')
 || '},"notes":[' || array_to_string(list_transform(list_filter([""" + ", ".join(f"ensembleOutcomes['{f}'].note" for f in FIELDS) + """], lambda x: x IS NOT NULL), lambda x: to_json(x)), ',') || ']}' AS json FROM batch_rows""",
    "image_count": "SELECT count(DISTINCT imageName) AS images, count(*) AS runs FROM batch_rows",
    "image_mode_cross": f"SELECT imageHash, mode FROM (SELECT DISTINCT imageHash FROM batch_rows WHERE imageHash IS NOT NULL), (VALUES {', '.join(f'({m!r})' for m in MODES)}) v(mode)",
    "fill_rate": _FILL,
    "ratio_format": f"SELECT mode, field, CASE WHEN total = 0 THEN '—' ELSE filled || '/' || total || ' (' || CAST(floor(filled * 100.0 / total + 0.5) AS BIGINT) || '%)' END AS ratio FROM ({_FILL})",
    "rung_table": _RUNG,
    "dead_rungs": f"SELECT rung, ran FROM ({_RUNG}) WHERE is_dead OR ran = 0",
    "engine_variant_matrix": _EV,
    "engine_variant_pivot": f"SELECT variant, CAST(coalesce(COLUMNS(* EXCLUDE (variant)), 0) AS BIGINT) FROM (PIVOT ({_EV}) ON engine USING sum(accepted) GROUP BY variant)",
    "merge_outcomes": f"SELECT field, confidence, count(*) AS n FROM {_OUT} GROUP BY 1, 2",
    "tiebreak_counts": f"""SELECT coalesce(k.t, g.t) AS tiebreak, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"('{t}')" for t in TIEBREAKS)}) k(t)
 FULL JOIN (SELECT tiebreak t, count(*) n FROM {_OUT} WHERE tiebreak IS NOT NULL GROUP BY 1) g ON k.t = g.t""",
    "latency_avg": "SELECT mode, runs, total_ms, pass1_ms, ladder_ms, total_ms // runs AS avg_total, pass1_ms // runs AS avg_pass1, ladder_ms // runs AS avg_ladder FROM (SELECT mode, count(*) runs, "
                   + ", ".join(f"CAST(coalesce(sum({n}Millis), 0) AS BIGINT) {n}_ms" for n in ("total", "pass1", "ladder")) + " FROM batch_rows GROUP BY mode)",
    "accuracy": _MATCH + " " + " UNION ALL ".join(f"SELECT mode, '{f}' AS field, count(t_{f}) AS compared, count(*) FILTER (WHERE {f} = t_{f}) AS correct FROM m GROUP BY mode" for f in FIELDS),
    "discarded_fields": f"SELECT rung, field, count(*) AS n FROM (SELECT e.rung AS rung, unnest(list_distinct(list_filter(e.produced, lambda x: NOT list_contains(e.accepted, x)))) AS field FROM {_EVENTS}) GROUP BY 1, 2",
    "missing_fields": f"""SELECT rowId, {_PRESENT.format(', '.join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in FIELDS))} AS present, odo IS NULL OR battery IS NULL OR range IS NULL AS is_missing FROM batch_rows""",
    "engine_retry_order": """SELECT rowId, string_agg(e.engine, ',' ORDER BY CASE WHEN e.engine = 'paddle' THEN 0 ELSE 1 END, pos) AS engines
 FROM (SELECT rowId, unnest(rungEvents) e, generate_subscripts(rungEvents, 1) pos FROM batch_rows) GROUP BY rowId""",
    "ensemble_merge": _merge_sql(),
    "fill_empty_ladder": "SELECT imageHash, " + ", ".join(f"arg_min({f}, rowId) FILTER (WHERE {f} IS NOT NULL) AS {f}, min(rowId) FILTER (WHERE {f} IS NOT NULL) AS {f}_rung" for f in FIELDS)
                         + ", count(DISTINCT rowId) AS rungs_seen FROM batch_rows WHERE imageHash IS NOT NULL GROUP BY 1",
    "ladder_events": "WITH o AS (SELECT rowId, imageHash, odo, battery, range, " + ", ".join(
        f"count({f}) OVER (PARTITION BY imageHash ORDER BY rowId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) n_{f}" for f in FIELDS) + " FROM batch_rows WHERE imageHash IS NOT NULL) SELECT rowId AS rung_no, " + ", ".join(
        _PRESENT.format(", ".join(f"CASE WHEN {f} IS NOT NULL{c.format(f)} THEN '{f}' END" for f in sorted(FIELDS))) + f" AS {n}"
        for n, c in (("produced", ""), ("accepted", " AND n_{} = 0"), ("discarded", " AND n_{} > 0"))) + " FROM o",
    "batch_csv_rows": _csv_sql(),
    "provenance_display": """SELECT rowId, x.key AS field, coalesce(CAST(x.value.value AS VARCHAR), '–') || ' ← ' || x.value.engine || ' / ' || x.value.variant || ' / ' || x.value.stage || coalesce(' [' || x.value.confidence || ']', '') AS shown
 FROM (SELECT rowId, unnest(map_entries(provenance)) x FROM batch_rows)""",
}

