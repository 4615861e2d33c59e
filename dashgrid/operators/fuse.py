"""Fusion of extractors: ensemble decisions, fill-empty merging and the ordered retry ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schemas import FIELDS, TIEBREAKS


def line_confidence(value: Column, lines: Column) -> Column:
    """Best confidence of the lines whose digits hold the value's; null and NaN don't count."""
    hit = F.filter(lines, lambda x: F.regexp_replace(x["text"], "[^0-9]", "").contains(value.cast("string")) & ~F.isnan(x["confidence"]) & x["confidence"].isNotNull())
    return F.array_max(F.transform(hit, lambda x: x["confidence"]))


def is_sane(field: str, v: Column, last_odo: Column) -> Column:
    if field == "odo":  # widened, so that the sum can't overflow
        last = last_odo.cast("long")
        return (v >= 0) & (last.isNull() | v.cast("long").between(last, last + 1000))
    return v.between(0, 100 if field == "battery" else 250)


def ensemble_field(field: str, a: Column, b: Column, engine_a: Column, engine_b: Column, conf_a: Column, conf_b: Column,
                   last_odo: Column, preferred: str = "paddle") -> Column:
    """struct<value,confidence,engine,note,tiebreak> of two extractors' values of one field."""
    sane_a, sane_b = is_sane(field, a, last_odo), is_sane(field, b, last_odo)
    known = conf_a.isNotNull() & conf_b.isNotNull() & (conf_a != conf_b)
    rule = (F.when(sane_a != sane_b, TIEBREAKS[0]).when(known, TIEBREAKS[1])
            .when((engine_a == preferred) | (engine_b == preferred), TIEBREAKS[2]).otherwise(TIEBREAKS[3]))
    first = F.when(sane_a != sane_b, sane_a).when(known, conf_a > conf_b).when(engine_a == preferred, True).otherwise(engine_b != preferred)
    out = lambda v, c, e, n, t: F.struct(v.cast("int").alias("value"), c.cast("string").alias("confidence"), e.cast("string").alias("engine"), n.cast("string").alias("note"), t.cast("string").alias("tiebreak"))
    null, text = F.lit(None), lambda c: c.cast("string")
    one, who = F.coalesce(a, b), F.when(a.isNotNull(), engine_a).otherwise(engine_b)
    won, winner = F.when(first, a).otherwise(b), F.when(first, engine_a).otherwise(engine_b)
    return (
        F.when(one.isNull(), out(null, null, null, null, null))
        .when(a.isNull() | b.isNull(), out(one, F.lit("MEDIUM"), who, F.concat(F.lit(f"{field}: only "), who, F.lit(" found "), text(one)), null))
        .when(a == b, out(a, F.lit("HIGH"), F.lit("both"), F.concat(F.lit(f"{field}: "), engine_a, F.lit(" and "), engine_b, F.lit(" agree on "), text(a)), null))
        .otherwise(out(won, F.lit("LOW"), winner, F.concat(
            F.lit(f"{field}: disagreement — "), engine_a, F.lit("="), text(a), F.lit(" vs "), engine_b, F.lit("="), text(b), F.lit("; took "), text(won),
            F.lit(" from "), winner, F.lit(" ("), rule, F.lit(")")), rule))
    )


def ensemble(df: DataFrame, preferred: str = "paddle") -> DataFrame:
    """Adds one outcome struct per field to rows with ``first`` and ``second``: struct<engine,odo,battery,range,lines>, and ``last_odo``."""
    a, b = F.col("first"), F.col("second")
    return df.withColumns({f"{f}_outcome": ensemble_field(f, a[f], b[f], a["engine"], b["engine"], line_confidence(a[f], a["lines"]), line_confidence(b[f], b["lines"]),
                                                          F.col("last_odo"), preferred) for f in FIELDS})


def fields_present(*values: Column) -> Column:
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.lit(f)) for f, v in zip(FIELDS, values))))


def newly_filled(before: dict[str, Column], after: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(before[f].isNull() & after[f].isNotNull(), F.lit(f)) for f in FIELDS)))


def separator(name: Column) -> Column:
    """The pseudo line between the lines of two passes."""
    return F.struct(F.concat(F.lit("— "), name, F.lit(" —")).alias("text"), *(F.lit(0).alias(x) for x in ("left", "top", "right", "bottom")), F.lit(None).cast("float").alias("confidence"))


def joined_lines(first: Column, second: Column, name: Column) -> Column:
    """Lines of both passes behind each other, with a separator unless the second pass has none."""
    return F.when(F.coalesce(F.size(second), F.lit(0)) <= 0, first).otherwise(F.concat(first, F.array(separator(name)), second))


def recovered(field: str, name: Column) -> Column:
    return F.concat(F.lit(f"{field}: recovered by "), name)


def fill_empty(first: Column, second: Column, name: Column | str) -> Column:
    """The first pass's struct<odo,battery,range,lines,notes>, completed from the second, named pass.

    Notes: the first pass's, one for each field recovered, then the second pass's under its name.
    """
    name = F.lit(name) if isinstance(name, str) else name
    gained = F.array_compact(F.array(*(F.when(first[f].isNull() & second[f].isNotNull(), recovered(f, name)) for f in FIELDS)))
    told = F.transform(second["notes"], lambda n: F.concat(name, F.lit(": "), n))
    return F.struct(*(F.coalesce(first[f], second[f]).alias(f) for f in FIELDS), joined_lines(first["lines"], second["lines"], name).alias("lines"),
                    F.concat(first["notes"], gained, told).alias("notes"))


def ladder(obs: DataFrame, key: list[str], order: str = "rung_no") -> DataFrame:
    """Folds ordered observations (key, order, odo, battery, range) to one row per key: the first value of each field wins.

    Adds ``<field>_rung`` (where it came from) and ``rungs_used``. Ties of the order go by value. One
    aggregation with map-side combining: the least struct(order, value) per field, no sort of the rungs.
    """
    best = {f: F.min(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("r"), F.col(f).alias("v")))).alias(f) for f in FIELDS}
    g = obs.groupBy(*key).agg(*best.values(), F.countDistinct(order).alias("rungs_seen"))
    return g.select(*key, *(F.col(f"{f}.v").alias(f) for f in FIELDS), *(F.col(f"{f}.r").alias(f"{f}_rung") for f in FIELDS), "rungs_seen")


def ladder_events(obs: DataFrame, key: list[str], order: str = "rung_no") -> DataFrame:
    """Every observation with produced, accepted and discarded fields: accepted are those no earlier one had."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    o = obs.withColumns({f"_{f}": F.first(f, True).over(w) for f in FIELDS})
    produced = fields_present(*(F.col(f) for f in FIELDS))
    accepted = newly_filled({f: F.col(f"_{f}") for f in FIELDS}, {f: F.col(f) for f in FIELDS})
    return o.withColumns({"produced": produced, "accepted": accepted}).withColumn("discarded", F.array_except("produced", "accepted")).drop(*(f"_{f}" for f in FIELDS))


def provenance_json(provenance: Column, engines: Column, notes: Column) -> Column:
    """Engines, fields and notes as JSON: a field has value, engine, variant, stage, confidence; nulls are written."""
    bare = F.transform_values(provenance, lambda _, p: F.struct(*(p[c].alias(c) for c in ("value", "engine", "variant", "stage", "confidence"))))
    return F.to_json(F.struct(engines.alias("engines"), bare.alias("fields"), notes.alias("notes")), {"ignoreNullFields": "false"})


def provenance_text(p: Column) -> Column:
    """``value <- engine / variant / stage [CONFIDENCE]``."""
    return F.concat(F.coalesce(p["value"].cast("string"), F.lit("–")), F.lit(" ← "), p["engine"], F.lit(" / "), p["variant"], F.lit(" / "), p["stage"],
                    F.coalesce(F.concat(F.lit(" ["), p["confidence"], F.lit("]")), F.lit("")))

