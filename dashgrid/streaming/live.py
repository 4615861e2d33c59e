"""Live results over a growing folder of readings.

The one reactive query of the data model is the whole table, newest first, again after each change. A
streaming file source with ``foreachBatch`` gives each change to a callback; the row-level differences of
two states are found by a keyed full join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.readings import newest_first


def watch(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The folder's parquet files as a stream; a schema is needed, none is inferred."""
    return spark.readStream.schema(schema).parquet(folder)


def live_newest(spark: SparkSession, folder: str, schema: StructType | str, emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``emit`` with the whole table, newest first, after every change; one micro-batch a change."""
    def changed(_: DataFrame, epoch: int) -> None:
        emit(newest_first(spark.read.schema(schema).parquet(folder)), epoch)

    return watch(spark, folder, schema).writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Readings and highest odometer per source and window of event time; rows later than the watermark are left out."""
    t = stream.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    g = t.groupBy(F.window("at", window), "vehicleId").agg(F.count("odoKm").alias("n"), F.max("odoKm").alias("odo"))
    return g.select(F.col("window.start").alias("start"), "vehicleId", "n", "odo")
