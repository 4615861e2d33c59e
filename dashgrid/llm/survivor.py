"""Best representative of each duplicate group: field-by-field survivorship in a single aggregation.

Per field the maximum of a composite struct (trust, time, id, value) over the members that have the
field is the survivor, so one aggregation with map-side combining settles all fields at once and a
group of any size, however hot, shrinks to one row per map task before the shuffle. As Spark keeps no struct
in a hash aggregation's buffer, both sides of the shuffle sort by the key first.

Defined results: null or unusable keys make no group; a group needs two different ids (a row delivered
twice is one record); a null trust flag counts as false; a null or out-of-period time counts as oldest;
a null id loses every tie; fields no member has give no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def with_canonical_sha256(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: 64 lower-case hex digits from any common spelling, null if the string can't be a content hash.

    Read are: any case, white space, the prefixes ``sha256:``, ``sha-256=`` and ``0x``, bytes separated by
    ``:`` or ``-``, and base64 (plain or URL-safe, padded or not). The hash of no bytes and strings of one
    repeated digit are no hashes. Each step is its own projection, so that none is computed twice.
    """
    df = df.withColumn("_c", F.translate(F.col(column), " \t\r\n\f\u000b\u00a0\u200b\ufeff", ""))
    df = df.withColumn("_s", F.regexp_replace("_c", "(?i)^sha-?256[:=_-]", ""))
    # base64 may itself begin with 0x, so that prefix is cut from the hex reading only
    df = df.withColumn("_h", F.lower(F.translate(F.regexp_replace("_s", "(?i)^0x", ""), ":-", "")))
    b64 = F.concat(F.translate("_s", "-_=", "+/"), F.lit("="))
    df = df.withColumn("_k", F.when(F.col("_h").rlike("^[0-9a-f]{64}$"), F.col("_h")).when(
        F.col("_s").rlike("^[A-Za-z0-9+/_-]{43}=?$"), F.lower(F.hex(F.try_to_binary(b64, F.lit("base64"))))))
    one_digit = F.replace(F.col("_k"), F.substring("_k", 1, 1), F.lit("")) == ""
    return df.withColumn(out, F.when(~one_digit & (F.col("_k") != EMPTY_SHA256), F.col("_k"))).drop("_c", "_s", "_h", "_k")


def survivors(df: DataFrame, key: str, row_id: str, fields: Sequence[str], trust: Column, time: Column) -> DataFrame:
    """One row per group: key, n_members and per field the surviving value and the id it came from (null if none)."""
    rank = [F.coalesce(trust, F.lit(False)).alias("trust"), F.coalesce(time, F.lit(-(1 << 63))).alias("time"), F.col(row_id).alias("id")]
    slim = df.select(F.col(key).alias("key"), *rank, *fields)
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct("trust", "time", "id", F.col(f).alias("value")))).alias(f"_{f}") for f in fields]
    g = slim.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("key").alias("n_members"), *best)
    g = g.where("lo < hi and n_members > 0")  # a count, so that no filter on the key is computed before it
    return g.select("key", "n_members", *(c for f in fields for c in (F.col(f"_{f}.value").alias(f), F.col(f"_{f}.id").alias(f"{f}_source"))))


def survivor_sources(s: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(key, field, source_id) of every field that some member has."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_source").alias("source_id")) for f in fields)))
    return s.select("key", each.alias("s")).select("key", "s.field", "s.source_id").where("source_id is not null")
