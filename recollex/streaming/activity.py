"""Streams of activity: windowed totals, the state of accesses, a text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions.scores import strength_after


def event_stream(spark, folder: str, schema) -> DataFrame:
    """Events of a growing folder of parquet files; ``ts`` without zone is read as UTC."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def activity_totals(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """``(window_start_us, event_type, n, value)``: totals a window; on a stream, windows close when the watermark has passed.  A null type is a type of its own."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.unix_micros(F.col("window.start")).alias("window_start_us"), "event_type", "n", "value")


def access_states(accesses: DataFrame, key: str, growth: float = 0.5) -> DataFrame:
    """``(key, accesses, last_us, strength)`` from a log of (key, ts): strength depends on the number of accesses only, so a running count is all the state a stream keeps."""
    timed = accesses.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.max(F.unix_micros("ts")).alias("last_us"))
    return counted.withColumn("strength", strength_after(F.lit(0.0), F.col("accesses"), growth))


def log_lines(events: DataFrame) -> DataFrame:
    """One line of text an event, for a text sink."""
    return events.select(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ["), F.coalesce("event_type", F.lit("?")), F.lit("] user="), F.coalesce(F.col("user_id").cast("string"), F.lit("-"))).alias("value"))
