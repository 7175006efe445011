"""Genetic map positions by monotone cubic interpolation (PCHIP), as windows over blocks of knots with halos.

Knots: chrom, bp, cm, one row per bp. Slopes at inner knots are the weighted harmonic mean of the neighbouring
secants (0 where they differ in sign), at the ends the three-point formula, kept monotone (Fritsch and Carlson;
Fritsch and Butland).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .asof import latest
from .ordered import WIDTH, haloed, numbered

#: Knots to a block.
KNOTS = 4096


def correct_blocks(markers: DataFrame, blocks: DataFrame) -> DataFrame:
    """cM values reversed among the markers of each block, by position; a block of two is a swap.

    ``markers``: chrom, bp, marker, cm. ``blocks``: chrom, marker, block.
    """
    rows = markers.join(blocks, ["chrom", "marker"], "left")
    up, down = Window.partitionBy("chrom", "block").orderBy("bp", "marker"), Window.partitionBy("chrom", "block").orderBy(F.col("bp").desc(), F.col("marker").desc())
    inside = rows.filter("block is not null").withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    other = inside.select(F.col("chrom").alias("_c"), F.col("block").alias("_b"), F.col("_d").alias("_o"), F.col("cm").alias("_cm"))
    fixed = inside.join(other, (F.col("chrom") == F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("_u") == F.col("_o")))
    fixed = fixed.select("chrom", "bp", "marker", F.col("_cm").alias("cm"))
    return rows.filter("block is null").select("chrom", "bp", "marker", "cm").unionByName(fixed)


def anchored(markers: DataFrame, lengths: DataFrame) -> DataFrame:
    """Knots: cM from 0, one row per bp (the smallest cM), with anchors at 0 and at the chromosome's end."""
    per = markers.groupBy("chrom").agg(F.min("cm").alias("least"), (F.max("cm") - F.min("cm")).alias("span"))
    rows = markers.join(per, "chrom").select("chrom", "bp", (F.col("cm") - F.col("least")).alias("cm"))
    ends = per.join(lengths, "chrom").select("chrom", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("bp"), F.lit(0.0).alias("cm")), F.struct(F.col("length").alias("bp"), F.col("span").alias("cm")))).alias("e"))
    every = rows.unionByName(ends.select("chrom", "e.bp", "e.cm"))
    return every.groupBy("chrom", "bp").agg(F.min("cm").alias("cm"))


def pieces(knots: DataFrame, size: int = KNOTS, width: int = WIDTH) -> DataFrame:
    """One row per pair of neighbouring knots: chrom, w_start, w_end, y0, y1, d0, d1 (values and slopes), and whether it is
    the chromosome's ``last``. A slope needs two knots to each side, which blocks of knots have from their neighbours.
    """
    knots = haloed(numbered(stored(knots.select("chrom", "bp", "cm"), "knots"), ["chrom"], "bp", ["bp"], width), size, 2)
    w = Window.partitionBy("chrom", "_block").orderBy("_number")
    x, y = F.col("bp").cast("double"), F.col("cm")
    rows = knots.withColumns({"h": F.lead(x).over(w) - x, "s": (F.lead(y).over(w) - y) / (F.lead(x).over(w) - x)})
    rows = rows.withColumns({"h_": F.lag("h").over(w), "s_": F.lag("s").over(w), "hn": F.lead("h").over(w), "sn": F.lead("s").over(w), "hp": F.lag("h", 2).over(w), "sp": F.lag("s", 2).over(w)})
    h, s, h_, s_ = F.col("h"), F.col("s"), F.col("h_"), F.col("s_")
    inner = F.when(s * s_ <= 0, F.lit(0.0)).otherwise((3 * (h + h_)) / ((2 * h + h_) / s_ + (h + 2 * h_) / s))

    def edge(h0, s0, h1, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return F.when(s1.isNull(), s0).when(F.signum(d) != F.signum(s0), F.lit(0.0)).when((F.signum(s0) != F.signum(s1)) & (F.abs(d) > 3 * F.abs(s0)), 3 * s0).otherwise(d)

    slope = F.when(s_.isNull(), edge(h, s, F.col("hn"), F.col("sn"))).when(s.isNull(), edge(h_, s_, F.col("hp"), F.col("sp"))).otherwise(inner)
    rows = rows.withColumn("d", slope)
    rows = rows.select("chrom", "_own", F.col("bp").alias("w_start"), F.lead("bp").over(w).alias("w_end"), F.col("cm").alias("y0"), F.lead("cm").over(w).alias("y1"), F.col("d").alias("d0"), F.lead("d").over(w).alias("d1"), F.lead("bp", 2).over(w).isNull().alias("last"))
    return rows.filter("_own and w_end is not null").drop("_own")


def _events(knots: DataFrame, size: int, width: int) -> DataFrame:
    """The pieces as events of an as-of join, stored."""
    names = ("w_start", "w_end", "y0", "y1", "d0", "d1", "last")
    return stored(pieces(knots, size, width).select("chrom", F.col("w_start").alias("at"), F.struct(*names).alias("event")), "pieces")


def _inside(bp: Column) -> Column:
    """Whether a position lies in the row's piece; the last knot does."""
    w_start, w_end = F.col("event.w_start"), F.col("event.w_end")
    return F.coalesce((bp >= w_start) & ((bp < w_end) | (F.col("event.last") & (bp == w_end))), F.lit(False))


def _value(bp: Column) -> Column:
    """cM at a position of the row's piece."""
    p = {n: F.col(f"event.{n}") for n in ("w_start", "w_end", "y0", "y1", "d0", "d1")}
    h = (p["w_end"] - p["w_start"]).cast("double")
    t = (bp - p["w_start"]) / h
    return (1 + 2 * t) * (1 - t) * (1 - t) * p["y0"] + t * (1 - t) * (1 - t) * h * p["d0"] + t * t * (3 - 2 * t) * p["y1"] + t * t * (t - 1) * h * p["d1"]


def interpolate(points: DataFrame, knots: DataFrame, size: int = KNOTS, width: int = WIDTH) -> DataFrame:
    """``cm`` at each point (chrom, bp and others); points outside the knots get none. The last knot is inside."""
    bp = F.col("point.bp")
    rows = latest(points, _events(knots, size, width), ["chrom"], "bp", width).filter(_inside(bp))
    return rows.select("point.*", _value(bp).alias("cm"))


def annotate(intervals: DataFrame, knots: DataFrame, size: int = KNOTS, width: int = WIDTH) -> DataFrame:
    """chrom, start, end, sample, marker, start_cM, end_cM, cM_per_Mb of each interval that starts or ends within the knots.

    An interval is one row, looked up by its start; by its end only where that lies in another piece.
    """
    events = _events(knots, size, width)
    columns = ["chrom", "start", "end", "sample", "marker"]
    every = intervals.select(*columns).distinct()
    at = lambda name, found: [F.when(found, _value(F.col(f"point.{name}"))).alias(f"{name}_cM"), found.alias(f"_{name}_in")]
    ends_here = _inside(F.col("point.end"))
    rows = latest(every.withColumn("_at", F.coalesce("start", "end")), events, ["chrom"], "_at", width)
    rows = rows.select(*[f"point.{c}" for c in columns], *at("start", _inside(F.col("point.start"))), *at("end", ends_here))
    rows = stored(rows, "annotated")
    here = F.col("_end_in") | F.col("end").isNull()
    beyond = rows.filter(~here).select(*columns, "start_cM", "_start_in")
    beyond = latest(beyond, events, ["chrom"], "end", width).select("point.*", *at("end", ends_here))
    rows = rows.filter(here).unionByName(beyond).filter("_start_in or _end_in").drop("_start_in", "_end_in")
    return rows.withColumn("cM_per_Mb", (F.col("end_cM") - F.col("start_cM")) / ((F.col("end") - F.col("start")) / 1e6))


def weighted_mean_rate(annotated: DataFrame) -> DataFrame:
    """One row: all cM over all Mb."""
    return annotated.agg((F.sum(F.col("end_cM") - F.col("start_cM")) / (F.sum(F.col("end") - F.col("start")) / 1e6)).alias("cM_per_Mb"))
