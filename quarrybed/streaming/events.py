"""Streaming forms of the order operators: quiet periods as sessions, first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Activity between quiet periods: key, session_start, session_end and n. Works on a stream or a table; on a stream
    a session is final once the watermark has passed it."""
    g = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def apply_per_batch(stream: DataFrame, transform, sink_path: str, checkpoint: str):
    """Any batch operator on each micro-batch, written under the batch's number so that a repeated batch replaces itself."""

    def one(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{sink_path}/batch={batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
