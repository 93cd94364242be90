"""The event dashboard over a log folder that grows: the same aggregation, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import events

SCHEMA = "ts double, event string, channel string"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def start(spark: SparkSession, folder: str, since: Column, table: str, checkpoint: str):
    """Starts the query over what is there now; its final state equals the batch dashboard's.

    Each batch is written to a folder of its own beside the checkpoint, and the view `table` then
    shows that; nothing is held on the driver.
    """
    rows = events.by_channel(stream(spark, folder), since)

    def show(batch: DataFrame, number: int) -> None:
        folder_ = f"{checkpoint.rstrip('/')}-{table}/batch-{number}"
        batch.write.mode("overwrite").parquet(folder_)
        spark.read.parquet(folder_).createOrReplaceTempView(table)

    return rows.writeStream.outputMode("complete").foreachBatch(show).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(rows: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event and window of time; windows close when the watermark has passed them."""
    timed = rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length), F.coalesce("event", F.lit("?")).alias("event")).agg(F.count("*").alias("n"))
