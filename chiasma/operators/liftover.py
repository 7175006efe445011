"""Points moved between assemblies by aligned blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import blocks_at
from .ordered import WIDTH


def lift_points(points: DataFrame, blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each point in each block that holds it: none, one or several rows.

    ``points``: chrom, start, end = start + 1, others. ``blocks``: chrom, w_start, w_end on the source, t_chrom,
    t_start, t_strand (a block of - counts back from the end of its target stretch, which begins at t_start).
    """
    rest = [c for c in points.columns if c not in ("chrom", "start", "end")]
    names = ("w_start", "w_end", "t_chrom", "t_start", "t_strand")
    rows = blocks_at(points, blocks.select("chrom", *names), "start", width=width)
    b = {n: F.col(f"block.{n}") for n in names}
    start = F.col("point.start")
    at = F.when(b["t_strand"] == "-", b["t_start"] + (b["w_end"] - 1 - start)).otherwise(b["t_start"] + (start - b["w_start"]))
    return rows.select(*[F.col(f"point.`{c}`") for c in rest], b["t_chrom"].alias("chrom"), at.alias("start"), (at + 1).alias("end"))
