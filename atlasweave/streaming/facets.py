"""Counts kept up to date over a stream of rows: an addition beside the batch operators, which have no streams to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """n and total of each key and window of event time; events later than the watermark are dropped, so state is bounded."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_to_end(spark: SparkSession, counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, upserted batch by batch into a table of whole results."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")
