"""Ground truth: built from saved readings or a CSV file, and matched to batch rows.

All truth keys are unique after de-duplication, so each match is an equi-join that never multiplies rows;
Spark broadcasts a side only when it measures as small. One truth entry per key comes from one aggregation that
combines map-side, so a key with a third of all readings costs each task one row. Rows without a hash or a name
match nothing; as outer joins send all null keys to one task, they are given one of many keys of no entry instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window as W

from ..functions.text import csv_escape, csv_split, normalise_name, strict_int, trim
from ..schemas import FIELDS


#: Labels of truth sets, header of a truth file, lines about matching.
READINGS_LABEL = "saved readings — %d corrected, %d confirmed-as-is"
CSV_LABEL = "ground_truth.csv (%d entries)"
TRUTH_HEADER = "filename,odo,battery,range"
NO_TRUTH = "Ground truth: none supplied"
NONE_MATCHED = "Ground truth: 0 of %d images matched (source: %s)"
SOME_MATCHED = "Ground truth: %d of %d images matched (source: %s) — %d corrected, %d confirmed-as-is"


def _entry(name: Column, odo: Column, battery: Column, range_: Column, corrected: Column) -> Column:
    return F.struct(name.alias("filename"), odo.alias("odo"), battery.alias("battery"), range_.alias("range"), corrected.alias("corrected"))


#: Keys handed out to rows that have none; longer than any hash or name in use, so that they meet no entry.
NOWHERE = 1024


def _reading_entry() -> Column:
    """A reading as an entry, named by its file, or by its id if it has none."""
    name = F.nullif(F.substring_index("imagePath", "/", -1), F.lit(""))
    return _entry(F.coalesce(name, F.concat(F.lit("reading_"), F.col("id").cast("string"))), F.col("odoKm"), F.col("batteryPct"), F.col("rangeKm"), F.coalesce("userEdited", F.lit(False)))


def _newest(readings: DataFrame, key: Column, out: str) -> DataFrame:
    """(out, entry): the newest reading of every non-null key; ties go to the lower id, a null time is oldest."""
    r = readings.select(key.alias(out), F.struct("timestamp", (-F.col("id")).alias("id"), _reading_entry().alias("entry")).alias("r")).where(F.col(out).isNotNull())
    return r.groupBy(out).agg(F.max("r").alias("r")).select(out, F.col("r.entry").alias("entry"))


def truth_by_hash(readings: DataFrame) -> DataFrame:
    """(hash, entry): the newest reading of every image hash."""
    return _newest(readings, F.col("imageHash"), "hash")


def truth_by_name(readings: DataFrame) -> DataFrame:
    """(name, entry): the newest reading of every image name, with or without a hash."""
    file = F.nullif(F.substring_index("imagePath", "/", -1), F.lit(""))
    return _newest(readings, F.when(file.isNotNull(), normalise_name(F.col("imagePath"))), "name")


def truth_counts(by_hash: DataFrame, by_name: DataFrame) -> DataFrame:
    """One row about a truth set of readings: entries by hash, by name, corrected, confirmed, its label."""
    h = by_hash.agg(F.count(F.lit(1)).alias("by_hash"), F.count_if("entry.corrected").alias("corrected"), F.count_if(~F.col("entry.corrected")).alias("confirmed"))
    n = by_name.agg(F.count(F.lit(1)).alias("by_name"))
    return h.join(n).select("by_hash", "by_name", "corrected", "confirmed", F.format_string(READINGS_LABEL, "corrected", "confirmed").alias("label"))  # one row each


def csv_label(by_name: DataFrame) -> DataFrame:
    """One row: the label of a truth set read from a CSV file."""
    return by_name.agg(F.count(F.lit(1)).alias("by_name")).select("by_name", F.format_string(CSV_LABEL, "by_name").alias("label"))


def newest_per(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each non-null key in the order given (a limit per group ahead of the shuffle and after it)."""
    w = W.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).where("_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def parse_truth_csv(lines: DataFrame, text: str = "value", line_no: str = "line_no") -> DataFrame:
    """(name, entry) of a positional CSV: comments, blanks and header lines (anywhere) go, the last line of a name wins."""
    t = trim(F.col(text))
    rows = lines.select(t.alias("t"), F.col(line_no).alias("line_no")).where("t is not null and t <> '' and not startswith(t, '#')").select("line_no", csv_split(F.col("t")).alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    first = trim(cell(0))
    rows = rows.where(~F.lower(first).isin("filename", "image"))
    rows = rows.select("line_no", first.alias("filename"), *(strict_int(cell(i + 1)).alias(f) for i, f in enumerate(FIELDS)))
    rows = newest_per(rows, F.nullif(normalise_name(F.col("filename")), F.lit("")), [F.desc("line_no")])
    return rows.select(F.col("_key").alias("name"), _entry(F.col("filename"), *(F.col(f) for f in FIELDS), F.lit(True)).alias("entry"))


def entries_by_name(entries: DataFrame, tie: list[Column]) -> DataFrame:
    """(name, entry) of a table of entries: one per normalised name, by the order given."""
    rows = newest_per(entries, F.nullif(normalise_name(F.col("filename")), F.lit("")), tie)
    return rows.select(F.col("_key").alias("name"), _entry(*(F.col(c) for c in ("filename", *FIELDS, "corrected"))).alias("entry"))


def match_truth(rows: DataFrame, by_hash: DataFrame, by_name: DataFrame) -> DataFrame:
    """Adds ``truth`` (by hash, else by name) and ``by_hash`` to batch rows."""
    h = by_hash.select(F.col("hash").alias("_h"), F.col("entry").alias("_eh"))
    n = by_name.select(F.col("name").alias("_n"), F.col("entry").alias("_en"))
    plain = [F.col(f.name) for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    nowhere = F.concat(F.lit("\u0000nowhere "), F.pmod(F.xxhash64(*plain), F.lit(NOWHERE)).cast("string"))
    d = rows.withColumns({"_kh": F.coalesce("imageHash", nowhere), "_kn": F.coalesce(F.nullif(normalise_name(F.col("imageName")), F.lit("")), nowhere)})
    d = d.join(h, F.col("_kh") == F.col("_h"), "left").join(n, F.col("_kn") == F.col("_n"), "left")
    return d.withColumns({"truth": F.coalesce("_eh", "_en"), "by_hash": F.col("_eh").isNotNull()}).drop("_h", "_eh", "_n", "_en", "_kh", "_kn")


def truth_csv_lines(entries: DataFrame, columns: Sequence[str] = ("filename", *FIELDS)) -> DataFrame:
    """Entries as lines of a truth CSV, without the header (``TRUTH_HEADER``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return entries.select(F.concat_ws(",", csv_escape(text(columns[0])), *map(text, columns[1:])).alias("value"))


def match_summary(matched: DataFrame, order: str = "rowId") -> DataFrame:
    """One row: images, matched, by hash, by name, corrected, confirmed; the last matched row of an image decides.

    The last row comes from a map-side maximum, not from sorting each image's rows.
    """
    last = F.max(F.when(F.col("truth").isNotNull(), F.struct(F.col(order).alias("o"), F.col("by_hash").cast("int").alias("h"), F.col("truth.corrected").cast("int").alias("c")))).alias("m")
    g = matched.where("imageName is not null").groupBy("imageName").agg(last)
    m = F.col("m")
    return g.agg(F.count(F.lit(1)).alias("images"), F.count(m).alias("matched"), F.count_if(m["h"] == 1).alias("by_hash"), F.count_if(m["h"] == 0).alias("by_name"),
                 F.count_if(m["c"] == 1).alias("corrected"), F.count_if(m["c"] == 0).alias("confirmed"))


def headline(summary: DataFrame, source: str | Column | None) -> DataFrame:
    """The report's line about matching, as one row; ``source`` is the truth set's label."""
    if source is None:
        return summary.select(F.lit(NO_TRUTH).alias("headline"))
    source = F.lit(source) if isinstance(source, str) else source
    some = F.format_string(SOME_MATCHED, "matched", "images", source, "corrected", "confirmed")
    return summary.select(F.when(F.col("matched") > 0, some).otherwise(F.format_string(NONE_MATCHED, "images", source)).alias("headline"))
