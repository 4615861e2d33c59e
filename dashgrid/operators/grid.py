"""Irregular readings onto a regular grid, by shape-preserving (monotone) cubic interpolation.

Readings are first averaged per source and grid cell, map-side, so a hot source holds one row per cell.
Cells are cut into time shards per source; each shard gets the two nearest knots of the shards before
and after it (the halo), which is all a monotone cubic needs, so shards are worked on independently and
agree at their borders. A gap longer than ``max_gap`` cells ends a segment and stays marked.

Defined results: rows with a null source, time or value are no readings; a cell whose readings are all
implausible counts as observed and takes its value from the curve; repeated rows weigh in the cell's
mean; a source with one cell gives one row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import DAY_MS


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point end derivative, limited so that the curve keeps the data's shape; d1 null: the secant."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(d1.isNull(), d0).when(F.signum(s) != F.signum(d0), 0.0).when(
        (F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def _mid_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Weighted harmonic mean of two secants, zero at a local extreme."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)


def regular_grid(df: DataFrame, source: str, t_ms: str, value: str, ok: Column | None = None, step_ms: int = DAY_MS,
                 shard_cells: int = 64, max_gap: int = 30) -> DataFrame:
    """One row per source and cell from its first to its last reading: (source, cell, n, value, status).

    ``ok`` marks plausible readings (default: all). status: observed, filled (interpolated) or gap (marked only).
    """
    ok = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    cells = df.where(F.col(source).isNotNull() & F.col(t_ms).isNotNull() & F.col(value).isNotNull()).groupBy(
        F.col(source).alias("source"), F.floor(F.col(t_ms) / step_ms).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(ok, F.col(value).cast("double"))).alias("y"))
    cells = cells.withColumn("shard", F.floor(F.col("x") / shard_cells))
    own = cells.select("source", "shard", "x", "n", "y", F.lit(True).alias("own"))
    rows = own.unionByName(_halo(cells))
    over = "OVER (PARTITION BY source, shard ORDER BY x, own)"
    nth = lambda f, c, i: F.expr(f"{f}({c}, {i}) IGNORE NULLS {over}")
    rows = rows.withColumn("k", F.when(F.col("y").isNotNull(), F.struct("x", "y")))
    rows = rows.withColumns({"p1": nth("lag", "k", 1), "p2": nth("lag", "k", 2), "n1": nth("lead", "k", 1), "n2": nth("lead", "k", 2),
                             "to": F.expr(f"lead(x) {over}")})

    def span(a: str, b: str) -> tuple[Column, Column]:
        """Length and slope between two knots; null where a segment ends."""
        h = (F.col(f"{b}.x") - F.col(f"{a}.x")).cast("double")
        h = F.when(h <= max_gap, h)
        return h, (F.col(f"{b}.y") - F.col(f"{a}.y")) / h

    for name, (a, b) in {"ll": ("p2", "p1"), "l": ("p1", "k"), "r": ("k", "n1"), "rr": ("n1", "n2")}.items():
        h, d = span(a, b)
        rows = rows.withColumns({f"h_{name}": h, f"d_{name}": d})
    h, d = (lambda i: F.col(f"h_{i}")), (lambda i: F.col(f"d_{i}"))
    rows = rows.withColumn("s", F.when(d("l").isNotNull() & d("r").isNotNull(), _mid_slope(h("l"), h("r"), d("l"), d("r")))
                           .when(d("r").isNotNull(), _end_slope(h("r"), h("rr"), d("r"), d("rr")))
                           .when(d("l").isNotNull(), _end_slope(h("l"), h("ll"), d("l"), d("ll"))))
    rows = rows.withColumn("s1", nth("lead", "s", 1)).withColumn("q", F.when(F.col("k").isNotNull(), F.struct(
        F.col("x").alias("x0"), F.col("y").alias("y0"), h("r").alias("h"), d("r").alias("d"), F.col("s").alias("s0"), F.col("s1"))))
    rows = rows.withColumn("q", F.last("q", True).over(W.partitionBy("source", "shard").orderBy("x", "own").rowsBetween(W.unboundedPreceding, 0)))
    # an own cell stands for itself and the cells without readings up to the next: all lie on one piece of the curve
    rows = rows.where("own").select("source", "x", "n", "y", "q", F.explode(F.sequence(F.col("x"), F.greatest(F.col("x"), F.coalesce("to", F.col("x") + 1) - 1))).alias("cell"))
    s, h, d = (F.col("cell") - F.col("q.x0")) / F.col("q.h"), F.col("q.h"), F.col("q.d")
    c2, c3 = 3 * d - 2 * F.col("q.s0") - F.col("q.s1"), F.col("q.s0") + F.col("q.s1") - 2 * d
    y = F.col("q.y0") + h * s * (F.col("q.s0") + s * (c2 + s * c3))
    seen = F.col("cell") == F.col("x")
    rows = rows.select("source", "cell", F.when(seen, F.col("n")).otherwise(F.lit(0)).alias("n"), F.when(seen & F.col("y").isNotNull(), F.col("y")).otherwise(y).alias("value"))
    return rows.withColumn("status", F.when(F.col("n") > 0, "observed").when(F.col("value").isNotNull(), "filled").otherwise("gap"))


def _halo(cells: DataFrame) -> DataFrame:
    """For every shard the two nearest knots of earlier and of later shards, and the next shard's first cell."""
    shards = cells.groupBy("source", "shard").agg(
        F.min("x").alias("first_x"), F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("x", "y")))).alias("knots"))
    up, down = W.partitionBy("source").orderBy("shard"), W.partitionBy("source").orderBy(F.desc("shard"))
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    k, n = F.col("knots"), F.size("knots")
    shards = shards.withColumns({"k_last": F.get(k, n - 1), "k_first": F.get(k, F.lit(0))})
    shards = shards.withColumns({"before": F.last("k_last", True).over(past(up)), "after": F.last("k_first", True).over(past(down)),
                                 "next_x": F.lag("first_x").over(down)})
    shards = shards.withColumns({
        "tail": F.when(n > 1, F.slice(k, -2, 2)).when(n == 1, F.array_compact(F.array("before", "k_last"))),
        "head": F.when(n > 1, F.slice(k, 1, 2)).when(n == 1, F.array_compact(F.array("k_first", "after"))),
    })
    shards = shards.withColumns({"tail": F.last("tail", True).over(past(up)), "head": F.last("head", True).over(past(down))})
    none = F.filter("knots", lambda c: F.lit(False))
    following = F.array(F.struct(F.col("next_x").alias("x"), F.lit(None).cast("double").alias("y")))
    return shards.select("source", "shard", F.explode(F.concat(F.coalesce("tail", none), F.coalesce("head", none), following)).alias("k")).where(
        F.col("k.x").isNotNull()).select("source", "shard", "k.x", F.lit(None).cast("long").alias("n"), "k.y", F.lit(False).alias("own"))
