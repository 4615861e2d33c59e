"""The readings table: scans, look-ups, appends, keyed updates, migrations, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.spatial import box_text
from ..session import DAY_MS


def newest_first(r: DataFrame) -> DataFrame:
    return r.orderBy(F.desc("timestamp"), "id")


def by_id(r: DataFrame, id_: int) -> DataFrame:
    return r.where(F.col("id") == id_)


def edited(r: DataFrame) -> DataFrame:
    return newest_first(r.where("userEdited"))


def missing_hash(r: DataFrame) -> DataFrame:
    return r.where("imageHash is null and imagePath is not null")


def max_odo(r: DataFrame) -> DataFrame:
    """One row, null for an empty table."""
    return r.agg(F.max("odoKm").alias("max_odo"))


def append(r: DataFrame, new: DataFrame, row_id: str = "id", part_ms: int = 60_000) -> DataFrame:
    """Rows with the ids that follow the table's: they count on from its maximum, in the order of ``timestamp``, ties and
    null times (first) in the order of the rows' own ``row_id``, which the new id replaces.

    The running number is the rank within a minute (null times: within a block of row ids) plus the rows of the minutes
    before, summed by minute within its day and by day; so no task has to hold all new rows, and nothing depends on how
    they are partitioned.
    """
    t, own = F.col("timestamp"), F.col(row_id)
    parts = new.withColumns({"_day": F.floor(t / DAY_MS), "_part": F.when(t.isNull(), F.floor(own / 65_536)).otherwise(F.floor(t / part_ms))})
    sizes = parts.groupBy("_day", "_part").agg(F.count(F.lit(1)).alias("_c"))
    days = sizes.groupBy("_day").agg(F.sum("_c").alias("_d"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_d").over(before(W.orderBy(F.asc_nulls_first("_day")))), F.lit(0)))  # one row a day
    sizes = sizes.withColumn("_in", F.coalesce(F.sum("_c").over(before(W.partitionBy("_day").orderBy("_part"))), F.lit(0)))
    same = F.col("x._day").eqNullSafe(F.col("y._day"))
    starts = sizes.alias("x").join(days.alias("y"), same).select("x._day", "_part", (F.col("_before") + F.col("_in")).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_day", "_part").orderBy("timestamp", row_id))
    ranked = parts.withColumn("_rank", rank).alias("x").join(starts.alias("y"), same & (F.col("x._part") == F.col("y._part"))).select("x.*", "_start")
    top = r.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return ranked.withColumn("id", top + F.col("_start") + F.col("_rank")).drop("_day", "_part", "_rank", "_start")


def set_hashes(r: DataFrame, updates: DataFrame) -> DataFrame:
    """The table with imageHash replaced where ``updates`` (id, hash) has the id; ids there must be unique."""
    u = updates.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    return r.join(u, F.col("id") == F.col("_id"), "left").withColumn("imageHash", F.coalesce("_hash", "imageHash")).drop("_id", "_hash")


def backfill_hashes(r: DataFrame, files: DataFrame) -> DataFrame:
    """(id, hash) for readings without a hash whose file (path, content) is there; the others are left out."""
    f = files.select(F.col("path").alias("imagePath"), F.sha2("content", 256).alias("hash")).where("hash is not null")
    return missing_hash(r).select("id", "imagePath").join(f, "imagePath").select("id", "hash")


def backfill(r: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the hashes of its files filled in, and one row with the number of readings that got one."""
    updates = backfill_hashes(r, files)
    return set_hashes(r, updates), updates.agg(F.count("hash").alias("updated"))


def migrate(r: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns a table of an older version lacks, as nulls."""
    return r.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in r.columns})


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots; unchanged ones are left out."""
    h = lambda d, n: d.select(F.col(key), F.struct(*columns).alias(n))
    j = h(old, "a").join(h(new, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def is_edited() -> Column:
    """Whether a saved value differs from the recognised one, nulls being equal."""
    same = F.col("odoKm").eqNullSafe(F.col("ocrOdo")) & F.col("batteryPct").eqNullSafe(F.col("ocrBattery")) & F.col("rangeKm").eqNullSafe(F.col("ocrRange"))
    return ~same


def row_text() -> Column:
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("–"))
    return F.concat(F.lit("Odo: "), show("odoKm"), F.lit(" km · Battery: "), show("batteryPct"), F.lit("% · Range: "), show("rangeKm"))


def time_text(style: str = "MMM d, y h:mm a") -> Column:
    """The reading's time for display, in the session's zone."""
    return F.date_format(F.timestamp_millis("timestamp"), style)


def warnings(last_odo: Column) -> Column:
    """The checks of a reading that fail, as an array of names; null values fail none."""
    o, last = F.col("odoKm").cast("long"), last_odo.cast("long")
    return F.array_compact(F.array(
        F.when(~F.col("batteryPct").between(0, 100), "battery"), F.when(o < last, "odo_lower").when(o > last + 1000, "odo_jump"), F.when(F.col("rangeKm") > 250, "range")))


def save_gate(last_odo: Column | None = None) -> Column:
    """struct<battery,refused,warnings>: a battery the field can't hold is cleared and the save refused; all else only warns."""
    bad = F.coalesce(~F.col("batteryPct").between(0, 100), F.lit(False))
    last = F.lit(None).cast("long") if last_odo is None else last_odo
    return F.struct(F.when(~bad, F.col("batteryPct")).alias("battery"), bad.alias("refused"), warnings(last).alias("warnings"))


#: The texts of the detail view and of the debug panels.
DETAIL = ("Odometer: %s km", "Battery: %s%%", "Range: %s km", "Raw OCR values — odo: %s, battery: %s, range: %s")
NO_LINES, SOURCES, NOTES = "(no OCR lines)", "Field sources:", "Parser notes:"
ENGINE_TITLE, NO_ENGINE_LINES = "%s (%d lines)", "(no lines)"


def detail_text() -> Column:
    """The detail view of a reading: time, event, values, recognised values and whether it was edited, one a line."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("–"))
    odo, battery, range_, ocr = DETAIL
    return F.concat_ws("\n", time_text(), "eventType", F.format_string(odo, show("odoKm")), F.format_string(battery, show("batteryPct")), F.format_string(range_, show("rangeKm")),
                       F.format_string(ocr, *map(show, ("ocrOdo", "ocrBattery", "ocrRange"))), F.when(F.col("userEdited"), "edited"))


def debug_text(lines: Column, sources: Column, notes: Column) -> Column:
    """The debug panel: lines with their boxes, sources of the fields, notes of the parser."""
    line = F.transform(lines, lambda x: F.concat(F.lit('"'), x["text"], F.lit('"  '), box_text(x)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    bullet = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("• "), x)), "\n")
    source = F.transform(F.map_entries(sources), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    head = F.when(some(lines), F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(NO_LINES)
    return F.rtrim(F.concat(head, F.when(some(sources), F.concat(F.lit(f"\n{SOURCES}\n"), bullet(source), F.lit("\n"))).otherwise(""),
                            F.when(some(notes), F.concat(F.lit(f"\n{NOTES}\n"), bullet(notes), F.lit("\n"))).otherwise("")), F.lit("\n "))


def engine_text(engine: Column, lines: Column) -> Column:
    """One engine's column of the comparison panel: each line with its confidence, and its box below."""
    line = F.transform(lines, lambda x: F.concat(F.lit('"'), x["text"], F.lit('"'), F.when(x["confidence"].isNotNull(), F.format_string(" %.2f", x["confidence"])).otherwise(""), F.lit("\n  "), box_text(x)))
    n = F.coalesce(F.size(lines), F.lit(0))
    return F.concat(F.format_string(ENGINE_TITLE, engine, n), F.lit("\n"), F.when(n > 0, F.array_join(line, "\n")).otherwise(NO_ENGINE_LINES))
