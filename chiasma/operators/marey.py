"""Cumulative recombination along a chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import WIDTH, stretched, within


def marey_curve(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """chromosome, rank, event_bp, cumulative: events so far per sample with an event on the chromosome."""
    events = stored(events.select("chromosome", "event_bp", "sample_id"), "marey-events")  # read three times
    samples = samples_per_chromosome(events)
    rows = stretched(events, ["chromosome"], F.col("event_bp"), {"before": ("sum", F.lit(1))}, width)
    rank = (F.col("before") + F.row_number().over(within(["chromosome"], "event_bp", "sample_id"))).cast("long")
    rows = rows.withColumn("rank", rank).join(samples, "chromosome")
    return rows.select("chromosome", "rank", "event_bp", (F.col("rank") / F.col("n_samples")).alias("cumulative"))


def samples_per_chromosome(events: DataFrame) -> DataFrame:
    return events.groupBy("chromosome").agg(F.count_distinct("sample_id").alias("n_samples"))
