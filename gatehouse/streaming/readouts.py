"""Streaming extension: readouts as an unbounded table, qualified as they come, with flag counts by event-time window.

The rules are a projection, so the batch code is the streaming code; only the windows need a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.operators.gates import readout_rules


def event_readouts(events: DataFrame) -> DataFrame:
    """Events as readouts: an error was not built, the value is the signal, and a value's CV grows with its distance from 50."""
    built = F.col("event_type") != "error"
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", built.alias("built"), F.when(built, F.col("value")).alias("value"), (F.abs(F.col("value") - 50) / 100).alias("replicate_cv"),
        (F.col("value") / 10).alias("signal"), (F.col("user_id") % 17 != 0).alias("controls_ok"),
    )


def flag_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window_start, n, flagged`` per event-time window, for a batch or a stream."""
    v = readout_rules().evaluate(event_readouts(events))
    if events.isStreaming:
        v = v.withWatermark("ts", late)
    counts = v.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("flagged"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "flagged")


def run_available(spark: SparkSession, path: str, name: str = "readout_flags") -> DataFrame:
    """Process what is there as a stream and return the final windows."""
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; a single file is matched by name in its own
    folder, _, leaf = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(folder)
    query = flag_windows(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)
