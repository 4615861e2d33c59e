"""Rolling totals over trailing periods, by binary doubling.

Per source and day the rows are summed map-side; each source's days are then filled to one row per day,
so a source holds no more rows than the calendar has days, whatever its number of records. Sums over 1,
2, 4, 8 ... days follow from each other by adding the block that lies that many days back; any window is
put together from those blocks. All blocks share one partitioning and one sort.

Defined results: rows with a null source or day are left out; null amounts count as zero; repeated rows
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import DAY_MS


def rolling_totals(daily: DataFrame, source: str, day: str, amounts: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Dense daily rows (source, day, <amount>, <amount>_<w>d, <amount>_<w>d_avg) from one or more rows per source and day.

    ``day`` is a day number; each average is over all days of the window, active or not.
    """
    pre = daily.where(F.col(source).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(source).alias("source"), F.col(day).cast("long").alias("day")).agg(
        *(F.coalesce(F.sum(F.col(a).cast("double")), F.lit(0.0)).alias(a) for a in amounts))
    w = W.partitionBy("source").orderBy("day")
    active = pre.withColumn("to", F.coalesce(F.lead("day").over(w), F.col("day") + 1))
    s = active.select("source", F.col("day").alias("at"), *amounts, F.explode(F.sequence(F.col("day"), F.col("to") - 1)).alias("day"))
    s = s.select("source", "day", *(F.when(F.col("day") == F.col("at"), F.col(a)).otherwise(0.0).alias(a) for a in amounts))
    earlier = lambda c, by: F.lag(c, by, 0.0).over(w)
    blocks, size, top = {1: {a: a for a in amounts}}, 1, max(windows)
    while 2 * size <= top:
        have, size = blocks[size], 2 * size
        s = s.withColumns({f"_{a}_{size}": F.col(have[a]) + earlier(have[a], size // 2) for a in amounts})
        blocks[size] = {a: f"_{a}_{size}" for a in amounts}
    out = {}
    for a in amounts:
        for n in windows:
            total, done = F.lit(0.0), 0
            for b in (1 << i for i in reversed(range(n.bit_length())) if n >> i & 1):
                total, done = total + (earlier(blocks[b][a], done) if done else F.col(blocks[b][a])), done + b
            out[f"{a}_{n}d"] = total
    s = s.withColumns(out)
    return s.select("source", "day", *amounts, *out, *((F.col(c) / n).alias(f"{c}_avg") for c, n in zip(out, [*windows] * len(amounts))))


def daily_distance(readings: DataFrame, source: str, t_ms: str, value: str, row_id: str) -> DataFrame:
    """(source, day, km, n): readings and the distance driven up to each day's readings.

    A day's distance is its highest value less the highest of the day with readings before it, no less
    than zero. Only (source, day) extremes meet in the window, so a hot source holds one row per day.
    """
    d = readings.groupBy(F.col(source).alias("source"), F.floor(F.col(t_ms) / DAY_MS).alias("day")).agg(
        F.max(value).alias("hi"), F.min(value).alias("lo"), F.count(value).alias("n"))
    w = W.partitionBy("source").orderBy("day")
    start = F.coalesce(F.last("hi", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("lo"))
    return d.select("source", "day", F.coalesce(F.greatest(F.lit(0), F.col("hi") - start), F.lit(0)).cast("double").alias("km"), "n")
