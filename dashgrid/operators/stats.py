"""Batch statistics: fill rates, rungs, engines and variants, merge outcomes, latency, accuracy.

Each is one pass with partial aggregation; closed dimensions are filled with zeros by a join to a constant table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import ratio_text
from ..schemas import FIELDS, RUNGS, TIEBREAKS, dimension


def fill_rate(rows: DataFrame) -> DataFrame:
    """(mode, field, filled, total): all fields in one aggregation, unpivoted afterwards."""
    g = rows.groupBy("mode").agg(*(F.count(f).alias(f) for f in FIELDS), F.count(F.lit(1)).alias("total"))
    return g.unpivot(["mode", "total"], [*FIELDS], "field", "filled").select("mode", "field", "filled", "total")


def rung_table(rows: DataFrame) -> DataFrame:
    """(rung, ran, produced, accepted, is_dead), known rungs that never ran included."""
    e = rows.select(F.explode("rungEvents").alias("e"))
    g = e.groupBy("e.rung").agg(F.count(F.lit(1)).alias("ran"), F.sum(F.size("e.produced")).alias("produced"), F.sum(F.size("e.accepted")).alias("accepted"))
    known = dimension(rows.sparkSession, "rung", RUNGS).drop("ord")
    d = known.join(g, "rung", "full").fillna(0)
    return d.withColumn("is_dead", (F.col("ran") > 0) & (F.col("accepted") == 0))


def engine_variant(rows: DataFrame) -> DataFrame:
    """(engine, variant, accepted) of pairs with accepted values."""
    e = rows.select(F.explode("rungEvents").alias("e")).select("e.engine", "e.variant", F.size("e.accepted").alias("n")).where("n > 0")
    return e.groupBy("engine", "variant").agg(F.sum("n").alias("accepted"))


def engine_variant_pivot(rows: DataFrame) -> DataFrame:
    """(variant, one column per engine seen), engines in order of their names; a pair without accepted values counts 0."""
    return engine_variant(rows).groupBy("variant").pivot("engine").agg(F.sum("accepted")).fillna(0)


def _outcomes(rows: DataFrame) -> DataFrame:
    o = rows.where("mode = 'BOTH'").select(F.explode("ensembleOutcomes").alias("field", "o"))
    return o.select("field", "o.confidence", "o.tiebreak").where("confidence is not null")


def merge_outcomes(rows: DataFrame) -> DataFrame:
    return _outcomes(rows).groupBy("field", "confidence").agg(F.count(F.lit(1)).alias("n"))


def tiebreak_counts(rows: DataFrame) -> DataFrame:
    g = _outcomes(rows).where("tiebreak is not null").groupBy("tiebreak").agg(F.count(F.lit(1)).alias("n"))
    return dimension(rows.sparkSession, "tiebreak", TIEBREAKS).drop("ord").join(g, "tiebreak", "full").fillna(0)


def latency(rows: DataFrame) -> DataFrame:
    """(mode, runs, totals and truncated averages); nulls count as zero, as a run without a figure took none."""
    names = {"total": "totalMillis", "pass1": "pass1Millis", "ladder": "ladderMillis"}
    g = rows.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{n}_ms") for n, c in names.items()))
    return g.withColumns({f"avg_{n}": F.expr(f"{n}_ms div runs") for n in names})


def accuracy(matched: DataFrame) -> DataFrame:
    """(mode, field, compared, correct): a missing value against a known truth counts as compared and wrong.

    No rows at all if no batch row has a truth.
    """
    g = matched.groupBy("mode").agg(*(x for f in FIELDS for x in (
        F.count(F.col("truth")[f]).alias(f"{f}_compared"), F.count_if(F.col(f) == F.col("truth")[f]).alias(f"{f}_correct"))), F.count("truth").alias("known"))
    g = g.withColumn("known", F.sum("known").over(W.partitionBy(F.lit(0)))).where("known > 0")  # one row per mode
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_compared").alias("compared"), F.col(f"{f}_correct").alias("correct")) for f in FIELDS)))
    return g.select("mode", each.alias("x")).select("mode", "x.*")


def ratios(fill: DataFrame) -> DataFrame:
    return fill.select("mode", "field", ratio_text(F.col("filled"), F.col("total")).alias("ratio"))


def unused_fields(rows: DataFrame) -> DataFrame:
    """(rung, field, n): values a rung produced that weren't accepted."""
    e = rows.select(F.explode("rungEvents").alias("e"))
    return e.select("e.rung", F.explode(F.array_except("e.produced", "e.accepted")).alias("field")).groupBy("rung", "field").agg(F.count(F.lit(1)).alias("n"))
