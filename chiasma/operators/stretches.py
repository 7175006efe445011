"""Markers in order, cut into rows of bounded size.

The markers of a (map, chromosome) are numbered in order of coordinate, name and genotypes without one task per
chromosome (``ordered``), and each ``STRETCH`` of them becomes a row for each block of ``SAMPLES`` samples. A row is some
tens of kilobytes whatever the length of the chromosome; what has to pass from one stretch to the next is the
operators' business: states of 64 samples, open runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import WIDTH, stretched, within

#: Samples to a block (the bits of a long), and markers to a row.
SAMPLES, STRETCH = 64, 512
KEYS = ["map", "chromosome", "block", "stretch"]


def marker_stretches(markers: DataFrame, size: int = STRETCH, width: int = WIDTH) -> DataFrame:
    """map, chromosome, block, stretch (from 0), n (samples of the block) and ``markers``: in order, of each coordinate,
    snp, genotypes of the block's samples (maybe fewer), and left_coordinate, left_snp of the marker before (null for the
    first of a chromosome). Markers without genotypes are left out.
    """
    own, place = ["map", "chromosome"], F.struct("coordinate", "snp")
    rows = markers.filter(F.length("genotypes") > 0).select(*own, "coordinate", F.col("snp_name").alias("snp"), "genotypes")
    carry = {"before": ("sum", F.lit(1)), "prior": ("max", place), "width": ("all", F.length("genotypes"))}
    rows = stretched(rows, own, F.col("coordinate"), carry, width)
    w = within(own, "coordinate", "snp", "genotypes")
    rows = rows.withColumns({"number": F.col("before") + F.row_number().over(w) - 1, "left": F.coalesce(F.lag(place).over(w), F.col("prior"))})
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / F.lit(SAMPLES)).cast("int"))))
    one = F.struct("number", "coordinate", "snp", F.substring("genotypes", F.col("block") * SAMPLES + 1, F.lit(SAMPLES)).alias("genotypes"), F.col("left.coordinate").alias("left_coordinate"), F.col("left.snp").alias("left_snp"))
    rows = rows.select(*own, "block", F.expr(f"number div {size}").alias("stretch"), F.least(F.lit(SAMPLES), F.col("width") - F.col("block") * SAMPLES).alias("n"), one.alias("one"))
    return rows.groupBy(*KEYS, "n").agg(F.array_sort(F.collect_list("one")).alias("markers"))
