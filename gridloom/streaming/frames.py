"""Rasters of tumbling windows of an event stream, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_frames(events: DataFrame, width: str = "1 day", late: str = "1 hour", bins: int = 24) -> DataFrame:
    """(frame_start, x, y, v): per window, user bin x and hour y, with the sum of values. Batch or streaming.

    State is one row per open window and cell; windows close when the watermark passes them.
    """
    # Watermarks take timestamps with a zone only; the frame's start goes back to local time.
    cells = events.filter("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.pmod("user_id", F.lit(bins)).cast("int").alias("x"), F.hour("ts").alias("y"))
    return cells.agg(F.sum("value").alias("v")).select(F.col("w.start").cast("timestamp_ntz").alias("frame_start"), "x", "y", "v")


def write_frames(stream: DataFrame, name: str, checkpoint: str | None = None):
    """Start the query into a table in memory, for tests; production streams take a Parquet sink and a checkpoint folder."""
    writer = stream.writeStream.outputMode("append").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
