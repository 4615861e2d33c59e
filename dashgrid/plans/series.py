"""Queries of the series operators over the pooled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import regular_grid
from ..operators.rolling import daily_distance, rolling_totals
from ..operators.spikes import find_spikes
from ..session import DAY_MS, PERIOD_END_MS, PERIOD_START_MS, table


def _day(c: str):
    return F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd")


def odo_readings(readings: DataFrame) -> DataFrame:
    """The readings of a day: a non-null odometer and a clock within the collection period."""
    return readings.where(F.col("odoKm").isNotNull() & F.col("timestamp").between(PERIOD_START_MS, PERIOD_END_MS - 1))


def with_plausible(readings: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """Readings with ``plausible``: the odometer isn't flagged. Null ids join nothing and stay plausible."""
    bad = find_spikes(readings, batch_rows).where("record = 'readings' and field = 'odoKm'").select(F.col("record_id").alias("id")).distinct()
    return readings.join(bad.withColumn("_flagged", F.lit(True)), "id", "left").withColumn("plausible", F.col("_flagged").isNull()).drop("_flagged")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spikes(table(spark, d, "readings"), table(spark, d, "batch_rows")).select("record", "record_id", "field")


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return find_spikes(table(spark, d, "readings"), table(spark, d, "batch_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid(odo_readings(table(spark, d, "readings")), "vehicleId", "timestamp", "odoKm")
    return g.where("status in ('filled', 'gap')").select(F.col("source").alias("vehicle_id"), _day("cell").alias("day"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    r = with_plausible(table(spark, d, "readings"), table(spark, d, "batch_rows"))
    g = regular_grid(odo_readings(r), "vehicleId", "timestamp", "odoKm", ok=F.col("plausible"))
    return g.select(F.col("source").alias("vehicle_id"), _day("cell").alias("day"), F.col("n").alias("n_readings"), F.col("value").alias("odo_km"), "status")


def p3_status(spark: SparkSession, d: str) -> DataFrame:
    """The grid over all readings of a day: how many each day has, and whether it is observed, filled or in a long gap."""
    g = regular_grid(odo_readings(table(spark, d, "readings")), "vehicleId", "timestamp", "odoKm")
    return g.select(F.col("source").alias("vehicle_id"), _day("cell").alias("day"), F.col("n").alias("n_readings"), "status")


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of each day and over the last 7 and 30 days, as totals and daily averages."""
    r = odo_readings(table(spark, d, "readings")).select("vehicleId", F.floor(F.col("timestamp") / DAY_MS).alias("day"), F.lit(1).alias("readings"))
    t = rolling_totals(r, "vehicleId", "day", ["readings"])
    return t.select(F.col("source").alias("vehicle_id"), _day("day").alias("day"), *(c for c in t.columns if c not in ("source", "day")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = odo_readings(table(spark, d, "readings")).select("vehicleId", F.floor(F.col("timestamp") / DAY_MS).alias("day"), F.lit(1).alias("n"))
    t = rolling_totals(r, "vehicleId", "day", ["n"])
    return t.where("n_7d = 0 and n_30d > 0").select(F.col("source").alias("vehicle_id"), _day("day").alias("day"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    r = odo_readings(with_plausible(table(spark, d, "readings"), table(spark, d, "batch_rows")))
    daily = daily_distance(r.withColumn("km", F.when(F.col("plausible"), F.col("odoKm"))), "vehicleId", "timestamp", "km", "id")
    counts = r.groupBy(F.col("vehicleId").alias("source"), F.floor(F.col("timestamp") / DAY_MS).alias("day")).agg(F.count("odoKm").alias("readings"))
    t = rolling_totals(daily.drop("n").join(counts, ["source", "day"], "full"), "source", "day", ["km", "readings"])
    return t.select(F.col("source").alias("vehicle_id"), _day("day").alias("day"), *(c for c in t.columns if c not in ("source", "day")))


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p3_found": p3_found, "p3_grid": p3_grid, "p3_status": p3_status, "p5_readings": p5_readings, "p5_found": p5_found, "p5_totals": p5_totals}

_DAYS = """SELECT DISTINCT vehicleId v, timestamp // 86400000 d FROM readings
 WHERE odoKm IS NOT NULL AND vehicleId IS NOT NULL AND timestamp >= 1672531200000 AND timestamp < 1767225600000"""

ORACLE = {
    "p3_found": f"""WITH days AS ({_DAYS}), x AS (SELECT v, d, lead(d) OVER (PARTITION BY v ORDER BY d) nx FROM days)
 SELECT v AS vehicle_id, strftime(DATE '1970-01-01' + CAST(g AS INTEGER), '%Y-%m-%d') AS day
 FROM (SELECT v, unnest(range(d + 1, nx)) g FROM x WHERE nx > d + 1)""",
    "p5_found": f"""WITH days AS ({_DAYS}), x AS (SELECT v, d, lead(d) OVER (PARTITION BY v ORDER BY d) nx FROM days)
 SELECT v AS vehicle_id, strftime(DATE '1970-01-01' + CAST(g AS INTEGER), '%Y-%m-%d') AS day
 FROM (SELECT v, unnest(range(d + 7, least(nx, d + 30))) g FROM x WHERE nx > d + 7)""",
    "p3_status": f"""WITH days AS (SELECT v, d, count(*) n FROM ({_DAYS.replace('DISTINCT ', '')}) GROUP BY ALL), x AS (SELECT v, d, n, lead(d) OVER (PARTITION BY v ORDER BY d) nx FROM days)
 SELECT v AS vehicle_id, strftime(DATE '1970-01-01' + CAST(g AS INTEGER), '%Y-%m-%d') AS day, CASE WHEN g = d THEN n ELSE 0 END AS n_readings,
 CASE WHEN g = d THEN 'observed' WHEN nx - d <= 30 THEN 'filled' ELSE 'gap' END AS status FROM (SELECT v, d, n, nx, unnest(range(d, coalesce(nx, d + 1))) g FROM x)""",
    "p5_readings": f"""WITH days AS (SELECT v, d, count(*) n FROM ({_DAYS.replace('DISTINCT ', '')}) GROUP BY ALL), x AS (SELECT v, d, n, lead(d) OVER (PARTITION BY v ORDER BY d) nx FROM days),
 e AS (SELECT v, g, CAST(CASE WHEN g = d THEN n ELSE 0 END AS DOUBLE) r FROM (SELECT v, d, n, unnest(range(d, coalesce(nx, d + 1))) g FROM x)),
 t AS (SELECT v, g, r, sum(r) OVER (PARTITION BY v ORDER BY g ROWS 6 PRECEDING) a, sum(r) OVER (PARTITION BY v ORDER BY g ROWS 29 PRECEDING) b FROM e)
 SELECT v AS vehicle_id, strftime(DATE '1970-01-01' + CAST(g AS INTEGER), '%Y-%m-%d') AS day, r AS readings, a AS readings_7d, b AS readings_30d, a / 7 AS readings_7d_avg, b / 30 AS readings_30d_avg FROM t""",
}
