"""Extension: the velocity of each alert's transactions as a stream, in sliding windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_counts(stream: DataFrame, window: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """alert_id, start, n for each sliding window; rows later than the watermark are left out."""
    timed = stream.withColumn("at", F.col("tx_ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("alert_id", F.window("at", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("alert_id", F.col("w.start").alias("start"), "n")


def replay(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, pattern: str = "events.parquet") -> DataFrame:
    """Run all files of a folder through the stream once, and return the table it wrote."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    stream = rows.select(F.col("user_id").alias("alert_id"), F.col("ts").alias("tx_ts"))
    counted = sliding_counts(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    counted.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("alert_id long, start timestamp, n long, batch long").parquet(out).drop("batch")
