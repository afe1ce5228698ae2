"""Streaming extensions: incremental chunks from new pages, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each type in windows; what comes later than ``late`` is left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Gap clusters of each user's events: the streaming twin of the batch operator."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_once(df: DataFrame, path: str, checkpoint: str, each=None) -> StreamingQuery:
    """All that is there now, as Parquet (or by ``each`` batch); a later call goes on from the checkpoint."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path).outputMode("append")).start()
    query.awaitTermination()
    return query
