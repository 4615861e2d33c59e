"""Session defaults and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Collection period of the pooled tables: [start, end) in epoch milliseconds, whole UTC days.
PERIOD_START_MS = 1672531200000
PERIOD_END_MS = 1767225600000
DAY_MS = 86_400_000


def build_session(app: str = "dashgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` overrides (dots written as ``__``)."""
    b = SparkSession.builder.appName(app).config(map={
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    })
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
