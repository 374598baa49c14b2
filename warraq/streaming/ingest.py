"""Structured Streaming forms of batch operators: an extension, as search archives grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warraq.operators import index


def timed(events: DataFrame, time: str) -> DataFrame:
    """events with a time column that a watermark takes; times without a zone are read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def counter_stream(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Running count and latest time of each key; state is one row for each key."""
    return timed(events, time).withWatermark(time, delay).groupBy(key).agg(F.count("*").alias("value"), F.max(time).alias("updated_at"))


def windowed_counts(events: DataFrame, key: str, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by time window; a window closes once the watermark has passed it."""
    return timed(events, time).withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def index_stream(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of each micro-batch to folder, once for each batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tokens = index.field_tokens(index.as_passages(batch))
        index.postings(tokens).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_parquet_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
