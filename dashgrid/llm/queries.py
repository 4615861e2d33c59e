"""Queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import PERIOD_END_MS, PERIOD_START_MS, table
from .bpe import encode_corpus, id_bytes
from .mixing import draw_mixes, ensure_checkpoint_dir, fold_source, mix_report, plan_mixes, with_quality
from .quantiles import merge_sketches, rank_error, read_sketches, sketch_groups
from .sentences import BLANK, sentence_units
from .survivor import survivor_sources, survivors, with_canonical_sha256

MILLIS = ("totalMillis", "pass1Millis", "ladderMillis")
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
FIELDS = ("odoKm", "batteryPct", "rangeKm")


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The documents' columns; a table in fewer splits than there are cores is spread over them first, as texts are costly to work on."""
    docs = table(spark, d, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and high percentiles of each mode, run day and timing."""
    s = sketch_groups(table(spark, d, "batch_rows"), ["mode", "runDay"], MILLIS)
    return read_sketches(s, QUANTILES).select("mode", "runDay", "metric", "n", *(F.col(q).cast("long").alias(q) for q in QUANTILES))


def p2_whole_period(spark: SparkSession, d: str) -> DataFrame:
    """The days' sketches combined into those of each mode's whole period."""
    s = merge_sketches(sketch_groups(table(spark, d, "batch_rows"), ["mode", "runDay"], MILLIS), ["mode"])
    return read_sketches(s, QUANTILES).select("mode", "metric", "n", *(F.col(q).cast("long").alias(q) for q in QUANTILES), F.lit(rank_error()).alias("rank_error"))


def p2_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of the whole period, put together from days, keeps its stated bound against the exact ranks."""
    est = p2_whole_period(spark, d)
    rows = table(spark, d, "batch_rows").select("mode", *MILLIS).unpivot("mode", [*MILLIS], "metric", "v").where("v is not null")
    # the percentiles are one row per mode (a closed domain) and timing, so broadcasting them has a bound
    rows = rows.alias("r").join(F.broadcast(est).alias("e"), F.col("r.mode").eqNullSafe(F.col("e.mode")) & (F.col("r.metric") == F.col("e.metric")))
    counts = [x for q in QUANTILES for x in (F.count_if(F.col("v") < F.col(q)).alias(f"lt_{q}"), F.count_if(F.col("v") <= F.col(q)).alias(f"le_{q}"))]
    g = rows.groupBy("e.mode", "e.metric", "n").agg(*counts)

    def kept(q: str, share: float):
        rank = F.greatest(F.lit(1), F.ceil(share * F.col("n") - 1e-9))
        off = F.greatest(F.lit(0), F.col(f"lt_{q}") + 1 - rank, rank - F.col(f"le_{q}"))
        return F.struct(F.lit(q).alias("quantile"), (off <= rank_error() * (F.col("n") - rank + 1) + 1).alias("kept"))

    return g.select("mode", "metric", "n", F.explode(F.array(*(kept(*x) for x in QUANTILES.items()))).alias("k")).select("mode", "metric", "n", "k.*")


def _photo_survivors(spark: SparkSession, d: str, fields=FIELDS) -> DataFrame:
    r = table(spark, d, "readings")
    in_time = F.when(F.col("timestamp").between(PERIOD_START_MS, PERIOD_END_MS - 1), F.col("timestamp"))
    return survivors(with_canonical_sha256(r, "imageHash", "photo"), "photo", "id", fields, F.col("userEdited"), in_time)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor_sources(_photo_survivors(spark, d), FIELDS).select(F.col("key").alias("image_hash"), "field", "source_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every photo saved more than once."""
    return _photo_survivors(spark, d, (*FIELDS, "eventType", "imagePath", "vehicleId")).withColumnRenamed("key", "image_hash")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_documents(spark, d, "doc_id", "text"), "text", ["doc_id"])


def p6_bytes(spark: SparkSession, d: str) -> DataFrame:
    """How many bytes each document's ids stand for: those of its text, or an id is lost or made up."""
    return id_bytes(p6_ids(spark, d), "ids", ["doc_id"])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents that can be drawn, with their tokens and weights; the counts are checkpointed, as they are the costly part."""
    docs = _documents(spark, d, "doc_id", "source", "lang", "text").select("doc_id", fold_source(F.col("source")).alias("source"), "lang", F.octet_length("text").alias("n_bytes"), "text")
    sized = encode_corpus(docs.where("source is not null"), "text", ["doc_id", "source", "lang", "n_bytes"], ids=False).where("n_tokens > 0")
    ensure_checkpoint_dir(spark)
    return with_quality(sized.checkpoint()).select("doc_id", "source", "n_tokens", "quality")


def p7_mixes(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix and how often each occurs."""
    return draw_mixes(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares aimed at and reached."""
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mix_report(draw_mixes(docs, targets), plan_mixes(docs, targets))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether each target's share is met to within one document and its repeats are kept; targets without documents or weight get nothing."""
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    report = mix_report(draw_mixes(docs, targets), plan_mixes(docs, targets))
    longest = docs.agg(F.max("n_tokens").alias("longest"))
    total = F.sum("tokens").over(W.partitionBy("mix"))
    r = report.withColumn("total", total).join(longest)  # one row
    share = F.abs(F.col("tokens") - F.col("target_tokens")) <= F.col("longest")
    return r.select("mix", "source", (share & (F.col("most_copies") <= F.coalesce("max_repeats", "most_copies"))).alias("kept"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document's units but blanks: all the text has, once."""
    u = p8_sentences(spark, d).select("doc_id", F.length(F.translate("sentence", BLANK, "")).alias("n"))
    return u.groupBy("doc_id").agg(F.sum("n").alias("n"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(_documents(spark, d, "doc_id", "text"), "text", ["doc_id"])


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(_documents(spark, d, "doc_id", "lang", "text"), "text", ["doc_id", "lang"], with_text=True)


QUERIES = {"p2_percentiles": p2_percentiles, "p2_whole_period": p2_whole_period, "p4_found": p4_found, "p4_records": p4_records, "p6_ids": p6_ids,
           "p7_mixes": p7_mixes, "p7_report": p7_report, "p8_found": p8_found, "p8_sentences": p8_sentences,
           "p2_rank_check": p2_rank_check, "p6_bytes": p6_bytes, "p7_kept": p7_kept, "p8_coverage": p8_coverage}

_HASHED = r"""SELECT *, CASE WHEN regexp_full_match(hx, '[0-9a-f]{64}') THEN hx
   WHEN regexp_full_match(s, '[A-Za-z0-9+/_-]{43}=?') THEN lower(hex(from_base64(translate(rtrim(s, '='), '-_', '+/') || '='))) END h0
 FROM (SELECT *, lower(regexp_replace(regexp_replace(s, '^0[xX]', ''), '[:-]', '', 'g')) hx
  FROM (SELECT *, regexp_replace(regexp_replace(imageHash, '\s+', '', 'g'), '^[sS][hH][aA]-?256[:=_-]', '') s FROM readings))"""

_SURVIVING = (*FIELDS, "eventType", "imagePath", "vehicleId")
_GROUPED = f"""(SELECT *, coalesce(userEdited, false) e, CASE WHEN timestamp BETWEEN {PERIOD_START_MS} AND {PERIOD_END_MS - 1} THEN timestamp ELSE -1 END t FROM ({_HASHED})
  WHERE h0 <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' AND h0 <> repeat(h0[1], 64))"""
_BLANKS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLE = {
    "p2_percentiles": "".join(f"""{' UNION ALL ' * (i > 0)}SELECT mode, runDay, '{m}' AS metric, count({m}) AS n, """ + ", ".join(
        f"CAST(quantile_disc({m}, {q}) AS BIGINT) AS {n}" for n, q in QUANTILES.items()) + f" FROM batch_rows WHERE {m} IS NOT NULL GROUP BY mode, runDay" for i, m in enumerate(MILLIS)),
    "p4_found": f"""WITH k AS (SELECT *, coalesce(userEdited, false) e,
  CASE WHEN timestamp BETWEEN {PERIOD_START_MS} AND {PERIOD_END_MS - 1} THEN timestamp ELSE -1 END t FROM ({_HASHED})
  WHERE h0 <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' AND h0 <> repeat(h0[1], 64)),
 g AS (SELECT h0 FROM k GROUP BY h0 HAVING count(DISTINCT id) > 1),
 v AS (""" + " UNION ALL ".join(f"SELECT h0, '{f}' field, id, e, t FROM k WHERE {f} IS NOT NULL" for f in FIELDS) + """)
 SELECT h0 AS image_hash, field, id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY h0, field ORDER BY e DESC, t DESC, id DESC) r FROM v JOIN g USING (h0)) WHERE r = 1""",
    "p4_records": "SELECT h0 AS image_hash, count(*) AS n_members, " + ", ".join(
        f"arg_max({f}, (e, t, id)) FILTER (WHERE {f} IS NOT NULL) AS {f}, arg_max(id, (e, t, id)) FILTER (WHERE {f} IS NOT NULL) AS {f}_source" for f in _SURVIVING) + f" FROM {_GROUPED} GROUP BY h0 HAVING count(DISTINCT id) > 1",
    "p2_rank_check": " UNION ALL ".join(f"SELECT mode, '{m}' AS metric, count({m}) AS n, '{q}' AS quantile, true AS kept FROM batch_rows GROUP BY mode HAVING count({m}) > 0" for m in MILLIS for q in QUANTILES),
    "p6_bytes": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents",
    "p7_kept": r"SELECT DISTINCT mix, nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '') AS source, true AS kept FROM mix_targets WHERE mix IS NOT NULL",
    "p8_coverage": f"SELECT doc_id, n FROM (SELECT doc_id, CAST(length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS BIGINT) AS n FROM documents) WHERE n > 0",
}
