"""Growing inputs: counts in tumbling windows, and sessions closed by a gap.

These are the streaming forms of tumbling bins and of merging intervals that lie within a gap; both keep state per
key and open window only, and late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, time: str, keys: list[str], size: str, lateness: str, value: str | None = None) -> DataFrame:
    """keys, start, end, n and total (of ``value``) per window."""
    total = F.sum(value) if value else F.count("*")
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), total.alias("total"))
    return rows.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def gap_sessions(stream: DataFrame, time: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """keys, start, end, n of runs of rows that follow each other within ``gap``."""
    rows = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append closed windows to Parquet, and stop."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
