"""Mixing sources to target weights: weighted sampling without replacement, to token budgets.

Each mix gets the largest total of which every source with documents can give its share within its
repeats (or ``budget``, if that is less). A source's part is a number of complete epochs and a rest; the
rest is drawn by Efraimidis-Spirakis sampling: every document gets the exponential key -ln(u) / quality,
documents are taken in the order of their keys, and their tokens are summed up to the rest.

Scale: keys are cut into buckets; bucket totals, summed map-side, tell in which bucket a source's rest runs
out. Buckets before it are taken whole, and only that bucket's documents are sorted and prefix-summed, so
neither a hot source nor the corpus is ever sorted. Token counts are computed once and checkpointed.

Defined results: documents without text, tokens or source give nothing; a source's spelling is folded
(case, blanks, hyphens); a target without documents, with a null or non-positive weight or without
repeats is reported with nothing drawn; several targets of one source in a mix count as one (weights
added, the least cap); null caps are no caps; repeated documents are separate; ties of keys go by id.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = 4096
SEED = 20250101


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; a temporary folder only in a session of one machine that names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def fold_source(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit(""))


def with_quality(docs: DataFrame, language: str = "lang", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds each document's weight within its source, ``quality`` in (0, 1]: how usual its tokens are for its language.

    A vocabulary spends more tokens on a byte of damaged, garbled or foreign text, and fewer on repeated signs, than is
    usual in the text's language. With z as the distance of log(bytes per token) from the language's mean, in standard
    deviations over all its documents, the weight is 1 / (1 + z**2). Languages are told by the first two letters of their
    code; unknown ones are measured together. The means come from one pass, one row per language.
    """
    code = F.coalesce(F.substring(F.lower(F.trim(F.col(language))), 1, 2), F.lit(""))
    d = docs.withColumns({"_lang": code, "_x": F.log(F.col(n_bytes) / F.col(n_tokens))})
    usual = d.groupBy("_lang").agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_dev"))
    z = F.coalesce((F.col("_x") - F.col("_mean")) / F.nullif("_dev", F.lit(0.0)), F.lit(0.0))
    return d.join(usual, "_lang").withColumn("quality", 1 / (1 + z * z)).drop("_lang", "_x", "_mean", "_dev")


def plan_mixes(docs: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """Per mix and source: share, available and target tokens, complete epochs and the rest to be drawn."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.where("mix is not null").groupBy("mix", fold_source(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)))).alias("weight"), F.min("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").fillna(0, ["available", "n_docs"])
    live = F.when((F.col("available") > 0) & F.coalesce(F.col("max_repeats") > 0, F.lit(True)), F.col("weight")).otherwise(0.0)
    w = W.partitionBy("mix")
    t = t.withColumn("share", F.coalesce(live / F.nullif(F.sum(live).over(w), F.lit(0.0)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("available") / F.col("share"))).over(w)
    whole = F.sum(F.when(F.col("share") > 0, F.col("available"))).over(w)
    total = F.coalesce(most, whole.cast("double"), F.lit(0.0))
    t = t.withColumn("target", F.col("share") * (total if budget is None else F.least(total, F.lit(float(budget)))))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("available", F.lit(0)) + 1e-9), F.lit(0))
    t = t.withColumn("epochs", F.coalesce(F.least(epochs, F.col("max_repeats")), epochs))
    return t.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("available")))


def draw_mixes(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(mix, source, doc_id, n_tokens, copies) of every document drawn. docs: doc_id, source, n_tokens, quality."""
    plan = plan_mixes(docs, targets, budget).where("target > 0").select("mix", "source", "epochs", "rest")
    rows = docs.join(plan, "source")
    u = (F.xxhash64(F.lit(seed), "mix", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    key = -F.log(u) / F.greatest("quality", F.lit(1e-9))
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(buckets * F.col("key") / (1 + F.col("key"))).cast("int"))
    sums = rows.where("rest > 0").groupBy("mix", "source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(W.partitionBy("mix", "source").orderBy("bucket"))
    cut = sums.withColumn("upto", upto).where("upto >= rest").groupBy("mix", "source").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("tokens"), "bucket").alias("before"))
    rows = rows.join(cut, ["mix", "source"], "left")
    whole = rows.where("cut is null or bucket <> cut").select(
        "mix", "source", "doc_id", "n_tokens", (F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))), 1).otherwise(0)).alias("copies"))
    w = W.partitionBy("mix", "source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.where("bucket = cut").withColumn("sum", F.col("before") + F.sum("n_tokens").over(w))
    edge = edge.select("mix", "source", "doc_id", "n_tokens", (F.col("epochs") + F.when(F.col("sum") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return whole.unionByName(edge).where("copies > 0")


def mix_report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual tokens and shares of each mix and source."""
    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("docs_drawn"), F.max("copies").alias("most_copies"))
    r = plan.select("mix", "source", "weight", "max_repeats", "n_docs", "available", F.col("share").alias("target_share"), F.col("target").alias("target_tokens")).join(
        got, ["mix", "source"], "left").fillna(0, ["tokens", "docs_drawn", "most_copies"])
    return r.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy("mix")), F.lit(0)), F.lit(0.0)))
