"""Label tables kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts (gene, label, start, n) per window; state older than the watermark is dropped, so it stays bounded."""
    return (
        events.where("user_id IS NOT NULL AND event_type IS NOT NULL")
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("gene"), F.col("event_type").alias("label"))
        .agg(F.count("*").alias("n"))
        .select("gene", "label", F.col("w.start").alias("start"), "n")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows as Parquet, everything that is there now; wait for the query that comes back."""
    return (
        counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
