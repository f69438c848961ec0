"""Activity as streams: an extension of the batch operators, with the same results.

Each takes a streaming DataFrame with an event time; watermarks bound the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.velocity import off_hours
from ..sources.session import checkpoint_dir

#: 1970-01-01 was a Thursday: weeks begin on Monday, four days later.
MONDAY = "4 days"


def velocity_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(start, total, off_hours) by week of the event time; a time without zone counts as the session's."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "7 days", "7 days", MONDAY)
    counts = events.withWatermark("ts", lateness).groupBy(w).agg(F.count("*").alias("total"), F.count_if(off_hours("ts")).alias("off_hours"))
    return counts.select(F.col("window.start").alias("start"), "total", "off_hours")


def sessions_stream(events: DataFrame, gap: str = "2 hours", lateness: str = "1 day") -> DataFrame:
    """(user_id, start, end, events): work sessions by a gap of inactivity."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """All that a stream over finite input gives, from one pass over what is there, as a table of files."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a loss takes the place of its first try
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/{number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; as a pattern the path may be a single file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_to_end(velocity_stream(events_stream(spark, sf_dir)), spark)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("period"), "total", "off_hours")
