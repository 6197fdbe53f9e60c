"""Progress of runs and idempotent completion, from a stream of events.

State is bounded: aggregates are one row per user and step, duplicates are held within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, files: int | None = 4) -> DataFrame:
    """Event files of a folder as a stream, few a batch; all that are there in one batch if files is None."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def steps_reached(stream: DataFrame, start: str = "signup") -> DataFrame:
    """user_id, started, first and last event ids of every step; output mode complete or update.

    A run begins at its latest start event: a step counts in it if its last event came later.
    """
    step = F.struct("event_id", F.col("event_type").alias("step"))
    by = stream.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == start, F.col("event_id"))).alias("started"),
        F.max_by(step, "event_id").alias("latest"),
        F.count("*").alias("n"),
    )
    return by.select("user_id", "started", F.col("latest.step").alias("step"), F.col("latest.event_id").alias("event_id"), "n")


def completed_once(stream: DataFrame, key=("user_id", "event_type"), delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark's delay; later copies are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*key])


def activity(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events by window and type; windows close once the watermark has passed them."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")
